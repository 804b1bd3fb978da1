"""Codes of what can be wrong with a PNG file, and of what can't be encoded."""

from __future__ import annotations

#: Live decode codes; the last ones are this engine's own, for input that would otherwise end the task.
DECODE = (
    "Io", "InvalidSignature", "Empty", "ChunkLength", "Crc32", "ImageDimensions", "BitDepth", "ColorType", "ColorMode",
    "CompressionMethod", "FilterMethod", "InterlaceMethod", "ChunkOrder", "Multiple", "NoImageData", "TrailingChunk",
    "UnknownChunkType", "ZlibTooSmall", "ZlibHeader", "PresetDict", "Inflate", "AdlerChecksum", "IllegalFilterType", "PhysUnits",
    "KeySize", "NoPalette", "PaletteIndex", "ShortData", "TextLength", "TooLarge",
)
#: Codes that are part of the vocabulary and that nothing raises.
UNUSED = ("BackgroundSize", "HuffmanEnd", "AlphaPaletteLen", "ChunkSize", "AlphaPaletteWithAlphaMode", "NoEnd", "NulTerm", "Eof")
ENCODE = ("Io", "KeySize", "BadPalette", "ColorMode", "ShortData", "ImageDimensions", "ChunkLength")
MESSAGES = {
    "Io": "the file ends inside a part of it", "InvalidSignature": "the first eight bytes are not those of a PNG", "Empty": "no chunk follows the signature",
    "ChunkLength": "a chunk has a length that its kind doesn't allow", "Crc32": "a chunk's checksum differs", "ImageDimensions": "width or height is 0",
    "BitDepth": "the bit depth is not 1 to 16", "ColorType": "unknown colour type", "ColorMode": "colour type and bit depth don't go together",
    "CompressionMethod": "unknown compression method", "FilterMethod": "unknown filter method", "InterlaceMethod": "unknown interlace method",
    "ChunkOrder": "a chunk is where it must not be", "Multiple": "a chunk is there twice", "NoImageData": "image data or the end chunk is missing",
    "TrailingChunk": "bytes follow the end chunk", "UnknownChunkType": "an unknown chunk follows the image data", "ZlibTooSmall": "too few bytes for a zlib stream",
    "ZlibHeader": "the zlib header's check fails", "PresetDict": "the zlib stream needs a preset dictionary", "Inflate": "the compressed data is damaged",
    "AdlerChecksum": "the inflated data's checksum differs", "IllegalFilterType": "a row's filter type is above 4", "PhysUnits": "unknown unit",
    "KeySize": "a keyword has not 1 to 79 bytes", "NoPalette": "a palette image without a palette", "PaletteIndex": "a pixel's index is not in the palette",
    "ShortData": "the data ends inside a row", "TextLength": "a text chunk has no end of its keyword", "TooLarge": "the image is above the limit set for it",
    "BadPalette": "a palette has not 1 to 256 colours",
}


class PngError(ValueError):
    """code is one of DECODE or ENCODE; detail names the chunk or value."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {MESSAGES[code]}" + (f" ({detail})" if detail else ""))
        self.code, self.detail = code, detail
