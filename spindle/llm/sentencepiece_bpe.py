r"""Encoding and decoding with a SentencePiece model of the merge type.

Encoding is exact and doesn't keep a queue of merges. A merge model has one encoding of each text, and a row of pieces is that encoding if and only if each two
neighbours are compatible: merging the text of both gives back the two. So a text is covered from the left with the longest piece that starts at a
position (an Aho-Corasick automaton gives the longest, a table the next shorter one that starts alike); the piece must be compatible with the one before, which is found by merging the two again, once for each pair;
where no piece fits, the position goes into a bitfield of failed positions, the piece before is taken back and a shorter one is tried there.
Pieces that merging never makes are left out of the automaton.

No piece reaches across some places (from any character to a word's leading space, around characters that no piece has, and between neighbours that no piece has
side by side), so a text is cut there first and the encodings of units are kept in a task, at most UNITS of them. Units can be of any length. A character that no piece has becomes its bytes.

Decoding joins the pieces, turns their space signs into spaces and takes the one of the first piece away; each byte piece that isn't part of UTF-8 becomes U+FFFD.

Nulls and ties: null and empty texts have no pieces (with an end id: that alone) and decode to the empty text. Null ids decode to null. Repeated rows are encoded each for
itself, very long texts as a whole. An empty table gives an empty result. Extra columns are kept; one that has the name of a new column is kept under `_name`.
Models that normalise characters, collapse spaces or have pieces of the kinds "user defined" and "unused" are refused."""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, require, table

SPACE = "▁"
#: UNITS: encodings kept in a task, of units of at most UNIT_CHARS characters. PAIRS: pairs of pieces whose compatibility is kept. ROWS: texts at a time.
UNITS, UNIT_CHARS, PAIRS, ROWS = 500_000, 200, 300_000, 1000
#: Kinds of pieces and fields of the model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

codecs.register_error("spindle-each-byte", lambda e: ("�", e.start + 1))


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, number()
            continue
        size = number() if wire == 2 else {5: 4, 1: 8}[wire]
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """The pieces of a model file, by id and by text, and what encoding needs of them."""

    def __init__(self, data: bytes):
        parts = list(_fields(data))
        trainer, normal = (dict(_fields(next((v for f, v in parts if f == n), b""))) for n in (2, 3))
        pieces = [dict(_fields(v)) for f, v in parts if f == 1]
        texts, kinds = [p[1].decode() for p in pieces], [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("only merge models with byte pieces and leading spaces are encoded")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model normalises texts or has pieces of its user")
        self.prefix, self.end = bool(normal.get(3, 1)), trainer.get(42, 2)
        self.ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == NORMAL}
        self.scores = {t: struct.unpack("<f", pieces[i].get(2, bytes(4)))[0] for t, i in self.ids.items()}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == BYTE}
        unknown = trainer.get(44, " ⁇ ".encode())
        self.shown = [unknown if k == UNKNOWN else b"" if k == CONTROL else bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(SPACE, " ").encode() for t, k in zip(texts, kinds, strict=True)]
        self.leads = {i for t, i in self.ids.items() if t.startswith(SPACE)}
        self.silent = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.known: dict[str, bytes] = {}  # and those kept before it was last full
        self.older: dict[str, bytes] = {}
        self.fitting: dict[tuple[str, str], bool] = {}

    def for_encoding(self) -> Model:
        """Makes the automaton and what goes with it, once."""
        if hasattr(self, "automaton"):
            return self
        import ahocorasick

        letters = {c for t in self.ids for c in t}
        self.side_by_side = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.longest = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        made = letters | {t for t in self.ids if len(self.merged(t)) == 1}
        for t in made:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        # the next shorter piece that starts alike
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in made), None) for t in made}
        known = "[" + "".join(map(re.escape, sorted(letters - {SPACE}))) + "]+"
        # without a piece that has a space sign after another character, no merge crosses the place before a space sign
        inner = any(SPACE in t.lstrip(SPACE) for t in self.ids)
        spaced = f"(?:{SPACE}|{known})+" if inner else f"{SPACE}*{known}|{SPACE}+"
        self.units = re.compile(f"{spaced}|[^{known[1:-2]}{SPACE}]+")
        return self

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by its merges: again and again the best-scored pair, of equals the first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max((self.scores.get(parts[i] + parts[i + 1], float("-inf")), -i) for i in range(len(parts) - 1))
            if best == float("-inf"):
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        found = self.fitting.get((left, right))
        if found is None:
            if len(self.fitting) >= PAIRS:
                self.fitting.clear()
            found = self.fitting[left, right] = self.merged(left + right) == [left, right]
        return found

    def pieces_of(self, text: str) -> list[str]:
        """The encoding of a text whose characters all stand in pieces."""
        out: list[str] = []
        failed = bytearray(len(text) // 8 + 1)
        longest_first, shorter, fitting, reach, size = self.automaton.iter_long, self.shorter, self.fitting, self.longest, len(text)
        at, left = 0, None
        piece = next(longest_first(text[:reach]))[1]
        while True:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if left is None:
                        break
                    fits = fitting.get((left, piece))
                    if self.fits(left, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            else:
                if left is None:
                    raise ArithmeticError("a text has no encoding")
                failed[at >> 3] |= 1 << (at & 7)
                piece = shorter[out.pop()]
                at -= len(left)
                left = out[-1] if out else None
                continue
            out.append(piece)
            if end == size:
                return out
            at, left = end, piece
            piece = next(longest_first(text[at : at + reach]))[1]

    def kept(self, unit: str, ids: bytes) -> bytes:
        if len(unit) <= UNIT_CHARS:
            if len(self.known) >= UNITS // 2:
                self.older = dict(self.known)
                self.known.clear()
            self.known[unit] = ids
        return ids

    def ids_of_part(self, part: str) -> bytes:
        found = array("i")
        for p in self.pieces_of(part) if self.automaton.match(part[0]) else part:
            found.extend([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()])
        return found.tobytes()

    def ids_of_unit(self, unit: str) -> bytes:
        """Of a unit that isn't kept yet: cut once more, between neighbours that no piece has side by side."""
        if unit in self.older:
            return self.kept(unit, self.older[unit])
        cuts = [0, *[i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.side_by_side], len(unit)]
        parts = [unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return self.kept(unit, b"".join([self.known.get(x) or self.kept(x, self.older.get(x) or self.ids_of_part(x)) for x in parts]))

    def encode(self, text: str | None, end: bool = False) -> bytes:
        """The ids, four bytes each."""
        ids, known = [], self.known.get
        if text:
            text = (" " * self.prefix + text).replace(" ", SPACE)
            ids = [known(unit) or self.ids_of_unit(unit) for unit in self.units.findall(text)]
        if end:
            ids.append(array("i", [self.end]).tobytes())
        return b"".join(ids)

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.silent), None)
        ends = [] if self.silent.isdisjoint(ids[:-1]) else [at for at, i in enumerate(ids) if i in self.silent]  # bytes on both sides of such a piece aren't one character
        runs = [ids[a:b] for a, b in zip([0, *ends], [*ends, len(ids)], strict=True)]
        text = "".join([b"".join([self.shown[i] for i in run]).decode("utf-8", "spindle-each-byte") for run in runs])
        return text[1 if self.prefix and first in self.leads else 0 :]


_models: dict[int, Model] = {}


def _model(data: bytes) -> Model:
    """Made once in a Python worker."""
    if hash(data) not in _models:
        _models.clear()
        _models[hash(data)] = Model(data)
    return _models[hash(data)]


def _named(df: DataFrame, column: str) -> DataFrame:
    for c in [c for c in df.columns if c.lower() == column.lower()]:
        df = df.withColumnRenamed(c, fresh(df, "_" + c)[0])
    return df


def _added(df: DataFrame, source: str, column: str, kind: str, arrow: pa.DataType, made) -> DataFrame:
    """df with a column that made (called in the task, gives a function of an Arrow array) makes of source."""
    schema = df.withColumn(column, F.lit(None).cast(kind)).schema
    at = df.columns.index(source)

    def run(batches):
        made_of = made()
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            new = made_of(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, new.cast(arrow)], names=[*batch.schema.names, column])

    return df.mapInArrow(run, schema)


def encoded(docs: DataFrame, model: bytes, text: str = "text", ids: str = "token_ids", end: bool = True) -> DataFrame:
    """Adds the ids of each text, with the end id if asked for. model: bytes of the model file (half a megabyte; they travel with the job)."""
    require(docs, text)

    def made():
        m = _model(model).for_encoding()

        def of(texts):
            each = [m.encode(t.as_py(), end) for t in texts]
            offsets = np.cumsum([0, *map(len, each)], dtype=np.int64) // 4
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(each), np.int32)))

        return of

    return _added(_named(docs, ids), text, ids, "array<int>", pa.list_(pa.int32()), made)


def decoded(tokens: DataFrame, model: bytes, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each row of ids."""
    require(tokens, ids)

    def made():
        m = _model(model)

        def of(column):
            ids, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            return pa.array([m.decode(ids[a:b].tolist()) if valid else None for a, b, valid in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)], pa.string())

        return of

    return _added(_named(tokens, text), ids, text, "string", pa.string(), made)


def model_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    """A file of the public tokenizers that are installed beside Python."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_bytes()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decoded(encoded(docs, model).drop("text"), model)
    return rows.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
