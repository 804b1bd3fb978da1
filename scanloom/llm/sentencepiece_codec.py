"""SentencePiece models on the tokenizers library.

The model's protobuf is read here, field by field, and rebuilt: its normaliser, the marker for spaces, scores (of a
unigram model, or as the merges of a BPE model), byte fallback and decoder. Batches are encoded by several threads.
Each result is compared with the sentencepiece library's own and decoded again; rows say if both agree.

The file of the model is read on the driver; workers get the rebuilt tokenizer and the model's bytes (a few MB, of the
model and not of the data).
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import raw, release, runs
from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
CHARS = 1_000_000  # bytes of a run of texts that is encoded at once


def fields(data: bytes):
    """(number, value) of a protobuf message's fields; values are ints, 4 or 8 bytes, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at : at + n]
            at += n


class Model:
    """pieces: (text, score, type) by id; the settings that encoding and decoding depend on."""

    def __init__(self, data: bytes):
        self.pieces, self.kind, self.byte_fallback, self.unknown = [], UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.extra_spaces_go, self.as_suffix = b"", True, True, False
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                for k, v in fields(value):
                    if k == 3:
                        self.kind = v
                    elif k == 24:
                        self.as_suffix = bool(v)
                    elif k == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for k, v in fields(value):
                    if k == 2:
                        self.charsmap = v
                    elif k == 3:
                        self.dummy_prefix = bool(v)
                    elif k == 4:
                        self.extra_spaces_go = bool(v)
        if self.kind not in (UNIGRAM, BPE) or self.as_suffix:
            raise ValueError("only unigram and BPE models with the marker before words can be rebuilt")
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def merges(model: Model) -> list[tuple[str, str]]:
    """The merges of a BPE model: each way to make a piece of two others, the best score first."""
    own = {p: s for p, s, k in model.pieces if k in (NORMAL, USER, UNUSED)}
    number = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = []
    for p, s in own.items():
        ways = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in own and p[i:] in own]
        found += [(-s, number[p], number[a], number[b], a, b) for a, b in ways]
    return [(a, b) for *_, a, b in sorted(found)]


def rebuild(data: bytes) -> str:
    """The tokenizer, as the tokenizers library's JSON."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = Model(data)
    if m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        inner = models.BPE(vocab, merges(m), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        # Pieces that are never found in a text must not be found here.
        worst = min(s for _, s, _ in m.pieces) - 1e4
        scores = [(p, s if k in (NORMAL, USER, UNUSED) else worst) for p, s, k in m.pieces]
        inner = models.Unigram(scores, m.unknown, m.byte_fallback)
    t = Tokenizer(inner)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.extra_spaces_go:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    # Words can be encoded one by one, and kept, if no piece holds a marker after something else.
    if not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in m.pieces if k in (NORMAL, USER, UNUSED)):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if m.dummy_prefix else steps)
    user = [p for p, _, k in m.pieces if k == USER]
    if user:
        from tokenizers import AddedToken

        t.add_tokens([AddedToken(p, normalized=True) for p in user])
    return t.to_str()


CACHE, SMALL = 60_000, 10_000  # words that a tokenizer keeps with their pieces (some 10 MB); if most words come to it once
KNOWN = 100_000  # words after which those that have been encoded are forgotten (some 20 MB)
TOGETHER, LONGEST = 500, 256  # new words that are encoded as one text, characters of a word


def tables(data: bytes) -> tuple[bool, np.ndarray, np.ndarray]:
    """What decoding needs of the model: whether texts begin with a marker, the pieces' lengths, and their bytes."""
    m = Model(data)
    pieces = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in m.pieces]
    return m.dummy_prefix, np.fromiter(map(len, pieces), np.int64, len(pieces)), np.frombuffer(b"".join(pieces), np.uint8)


class Codec:
    """Encodes and decodes with the rebuilt tokenizer; compares with the sentencepiece library."""

    def __init__(self, rebuilt: str, data: bytes, parts: tuple[bool, np.ndarray, np.ndarray], threads: int):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from tokenizers import Tokenizer, normalizers

        import sentencepiece

        self.tokenizer = Tokenizer.from_str(rebuilt)
        # A normaliser that only sets marks is left to Python, where no positions are kept; user pieces are found before it.
        made = json.loads(rebuilt)
        steps = [x["type"] for x in made["normalizer"]["normalizers"]]
        self.marks = not made["added_tokens"] and steps in (["Prepend", "Replace"], ["Replace"])
        self.first = MARK if steps[0] == "Prepend" else ""
        if self.marks:
            self.tokenizer.normalizer = normalizers.Sequence([])
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.prefix, self.lengths, self.all_bytes = parts
        self.size, self.starts = len(self.lengths), np.cumsum(self.lengths) - self.lengths
        # Then each word that begins with one marker is encoded once, and texts are put together of words.
        self.by_word = bool(self.marks and self.first and made["pre_tokenizer"] and made["model"]["byte_fallback"])
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(SMALL if self.by_word else CACHE)
            self.tokenizer.model = model
        self._forget()

    def _forget(self) -> None:
        """words: the number of each word that has been encoded; at, counts: where its pieces are in flat."""
        self.words, self.chars = {}, 0
        self.at, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @cached_property
    def bytes(self) -> list[bytes]:
        ends = np.cumsum(self.lengths).tolist()
        whole = self.all_bytes.tobytes()
        return [whole[i:j] for i, j in zip(self.starts.tolist(), ends)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.marks:
            texts = [f"{self.first}{x}".replace(" ", MARK) if x else x for x in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encodes words that are new, many in one text: they are apart where the pieces' bytes say so."""
        flats, counts = [], []
        parts = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        made = self.tokenizer.encode_batch_fast(["".join([f"{MARK}{w}" for w in part]) for part in parts], add_special_tokens=False)
        for part, e in zip(parts, made):
            flat = np.array(e.ids, np.int32)
            reached = np.cumsum(self.lengths[flat])
            wanted = np.cumsum([len(w.encode()) + 1 for w in part])
            end = np.searchsorted(reached, wanted)
            if end[-1] != len(flat) - 1 or (reached[end] != wanted).any():
                alone = [e.ids for e in self.tokenizer.encode_batch_fast([f"{MARK}{w}" for w in part], add_special_tokens=False)]
                flat, end = np.fromiter(chain.from_iterable(alone), np.int32), np.cumsum([len(x) for x in alone]) - 1
            flats.append(flat)
            counts.append(np.diff(end, prepend=-1))
        counts = np.concatenate(counts)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(counts) - counts])
        self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, *flats])
        self.words.update(zip(words, range(len(self.words), len(self.at))))
        self.chars += sum(map(len, words))

    def encode_flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids): what encode() says, each word once. Texts with markers, with
        spaces side by side or at an end, or with very long words are encoded as a whole."""
        if not self.by_word:
            ids = self.encode(column.to_pylist())
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())), counts
        if len(self.words) > KNOWN or self.chars > 16 * KNOWN:
            self._forget()
        split = pc.split_pattern(column, " ")
        sizes = split.value_lengths().to_numpy()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        number = list(map(self.words.get, words))
        missing = [k for k, x in enumerate(number) if x is None]
        whole = np.zeros(len(words), bool)
        whole[[k for k in missing if not (w := words[k]) or len(w) > LONGEST or MARK in w]] = True
        new = [k for k in missing if not whole[k]] if whole.any() else missing
        first = len(self.words)
        if new:
            self._learn([words[k] for k in new])
        for k in missing:
            number[k] = 0
        number = np.array(number, np.int64)
        number[new] = np.arange(first, first + len(new))
        place = coded.indices.to_numpy()
        text = np.repeat(np.arange(len(sizes)), sizes)
        odd = np.zeros(len(sizes), bool)
        odd[text[whole[place]]] = True
        plain = ~odd[text]
        number, text = number[place[plain]], text[plain]
        n = self.counts[number]
        counts = np.bincount(text, n, len(sizes)).astype(np.int64)
        flat = self.flat[np.repeat(self.at[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        if odd.any():
            own = self.encode(column.filter(pa.array(odd)).to_pylist())
            counts[odd] = [len(x) for x in own]
            here = np.repeat(odd, counts)
            both = np.empty(len(here), np.int32)
            both[~here], both[here] = flat, np.fromiter(chain.from_iterable(own), np.int32)
            flat = both
        return flat, counts

    def decode(self, ids: list[list[int]]) -> list[str]:
        """What the tokenizer's decoder says. Where the pieces' bytes are UTF-8 as they are, that is their text without
        the first marker; only the rest needs the decoder, which replaces what is not."""
        out, piece = [], self.bytes.__getitem__
        for x in ids:
            try:
                text = b"".join(map(piece, x)).decode()
                out.append(text[1:] if self.prefix and text[:1] == " " else text)
            except (UnicodeDecodeError, IndexError):
                out.append(self.tokenizer.decode([i for i in x if 0 <= i < self.size], skip_special_tokens=False))
        return out

    def round_trips(self, ids: list[list[int]], data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether each text's ids decode to its bytes: the pieces' bytes side by side, without the first marker. Bytes
        that are no UTF-8 are no text's."""
        piece, out = self.bytes.__getitem__, np.zeros(len(ids), bool)
        for k, (x, i, j) in enumerate(zip(ids, off[:-1].tolist(), off[1:].tolist())):
            own = b"".join(map(piece, x))
            out[k] = (own[1:] if self.prefix and own[:1] == b" " else own) == data[i:j].tobytes()
        return out


def agree(ids: list[list[int]], flat: np.ndarray, end: np.ndarray) -> list[bool]:
    """Whether each list has the numbers that flat has for it; end: where they end there."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    same = n == np.diff(end, prepend=0)
    if not same.all():
        return [ok and x == flat[k - len(x) : k].tolist() for x, ok, k in zip(ids, same.tolist(), end.tolist())]
    differ = np.concatenate([[0], np.cumsum(np.fromiter(chain.from_iterable(ids), np.int32, len(flat)) != flat)])
    return (differ[end] == differ[end - n]).tolist()


_codecs: dict = {}


def _codec(rebuilt: str, data: bytes, parts: tuple, threads: int) -> Codec:
    key = (hash(rebuilt), threads)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rebuilt, data, parts, threads)
    return _codecs[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


ADDED = (("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("round_trip", T.BooleanType()), ("parity", T.BooleanType()))


def encode_column(docs: DataFrame, text_col: str = "text", model_path: str = MODEL, threads: int = 2, parity: bool = True) -> DataFrame:
    """docs with ids, n_tokens, round_trip (decoding the ids gives the text back) and parity (the sentencepiece library
    has the same ids; null if not asked for). Columns of these names are replaced; the others and all rows stay.
    A null text has null in all four; an empty one has no ids. Repeated rows have equal results, an empty table gives an
    empty one, and a text of any length is encoded as a whole."""
    rows = docs.drop(*(n for n, _ in ADDED))
    at = rows.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in ADDED)])
    data = read_model(model_path)
    shared = docs.sparkSession.sparkContext.broadcast((rebuild(data), data, tables(data)))  # the model: a few MB

    def run(batches):
        codec = _codec(*shared.value, threads)
        for batch in batches:
            column = batch.column(at)
            raw_bytes, off = raw(column)
            for i, j in runs(np.diff(off), CHARS):
                part = batch.slice(i, j - i)
                there = np.array(column.slice(i, j - i).is_valid())
                texts = pc.fill_null(column.slice(i, j - i), "")
                own = texts.to_pylist()
                flat, counts = codec.encode_flat(texts)
                end = np.cumsum(counts)
                if parity:
                    theirs = codec.own.encode(own, num_threads=1)
                    same = agree(theirs, flat, end)
                else:
                    theirs = same = [None] * len(own)
                ids = [x if ok else flat[k - m : k].tolist() for x, ok, k, m in zip(theirs, same, end.tolist(), counts.tolist())]
                back = codec.round_trips(ids, raw_bytes, off[i : j + 1])
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.int32())
                cols = [pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(counts), pa.array(back), pa.array(same, pa.bool_())]
                if not there.all():
                    cols = [pc.if_else(pa.array(there), c, pa.nulls(len(c), c.type)) for c in cols]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], schema.names)
                del ids, theirs, own, flat, back, same, cols
        del codec
        _codecs.clear()
        release()

    return rows.mapInArrow(run, schema)


def decode_column(df: DataFrame, ids_col: str = "ids", to: str = "text", model_path: str = MODEL, threads: int = 2) -> DataFrame:
    """df with `to` (replaced if it is there): the text of the ids. Null ids give null, no ids an empty text; ids that
    the model lacks are left out."""
    rows = df.drop(to)
    at = rows.columns.index(ids_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())])
    data = read_model(model_path)
    shared = df.sparkSession.sparkContext.broadcast((rebuild(data), data, tables(data)))

    def run(batches):
        codec = _codec(*shared.value, threads)
        for batch in batches:
            ids = batch.column(at).to_pylist()
            texts = iter(codec.decode([[i for i in x if i is not None] for x in ids if x is not None]))
            out = [None if x is None else next(texts) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encode_column(docs).drop("text")
