"""SentencePiece encoding with source spans, and decoding.

The model's rules run in two steps. ``Normalizer`` reads the compiled character
map (a double-array trie followed by replacement strings), replaces the longest
matching prefix at each position, and records for every normalised byte where
its source begins. Pieces are then found in the normalised text and projected
through that record to byte spans of the original.

No piece of a model whose pieces have the form ``▁*[^▁]*`` crosses from a word
to the white space after it. The text of such a model is segmented word by word
and each task remembers words it has seen, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
SEEN = 150_000  # words that a task remembers
GROUP = 1 << 19  # bytes of text encoded, and returned, at once


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class CharacterMap:
    """Longest-prefix lookup in a compiled character map."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if size else []
        self.targets = blob[4 + size :]
        starts = {b for b in range(256) if self._step(self._begin(), b) is not None} if self.units else set()
        self.plain = re.compile(b"[^" + b"".join(re.escape(bytes([b])) for b in sorted(starts)) + b"]+", re.S) if starts else re.compile(rb".+", re.S)

    @staticmethod
    def _jump(unit: int) -> int:
        """Distance from a unit to its children."""
        return (unit >> 10) << ((unit >> 6) & 8)

    def _begin(self) -> int:
        return self._jump(self.units[0])

    def _step(self, base: int, byte: int) -> int | None:
        """Position of the child for ``byte``, or None where the trie ends."""
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest rule that begins at ``at``, and its replacement."""
        if not self.units:
            return None
        base, found = self._begin(), None
        for k in range(at, len(text)):
            child = self._step(base, text[k])
            if child is None:
                break
            unit = self.units[child]
            base = child ^ self._jump(unit)
            if unit >> 8 & 1:  # a rule ends here; its value is the first child
                found = k + 1 - at, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.targets[found[1] : self.targets.index(b"\0", found[1])]


class Normalizer:
    """Normalised text and, for each of its bytes and its end, the source offset."""

    def __init__(self, spec, suffix: bool) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.squeeze = spec.remove_extra_whitespaces
        self.dummy = spec.add_dummy_prefix
        self.mark = SPACE.encode() if spec.escape_whitespaces else b" "
        self.suffix = suffix
        self.simple = not self.map.units and not self.squeeze and not suffix

    def __call__(self, source: bytes) -> tuple[bytes, np.ndarray]:
        if not source:
            return b"", np.zeros(1, np.int64)
        if self.simple:
            width = np.where(np.frombuffer(source, np.uint8) == 32, len(self.mark), 1)
            head = np.zeros(len(self.mark) if self.dummy else 0, np.int64)
            align = np.concatenate([head, np.repeat(np.arange(len(source)), width), [len(source)]])
            return (self.mark if self.dummy else b"") + source.replace(b" ", self.mark), align
        return self._mapped(source)

    def _replaced(self, source: bytes) -> Iterator[tuple[bytes, int, bool]]:
        """Replacement, source length, and whether each byte stands for itself."""
        at = 0
        while at < len(source):
            run = self.map.plain.match(source, at)
            if run:
                at = run.end()
                yield run[0], len(run[0]), True
                continue
            rule = self.map.longest(source, at)
            if rule:
                length, target = rule
                yield target, length, False
            else:
                length = next((n for n in (1, 2, 3, 4) if _is_character(source[at : at + n])), 1)
                yield source[at : at + length], length, False
            at += length

    def _mapped(self, source: bytes) -> tuple[bytes, np.ndarray]:
        out, align, at, blank = bytearray(), [], 0, self.squeeze
        started = False
        for target, length, itself in self._replaced(source):
            for k, byte in enumerate(target):
                origin = at + k if itself else at
                if byte == 32 and blank:
                    continue
                if not started:
                    started = True
                    if self.dummy and not self.suffix:
                        out += self.mark
                        align += [origin] * len(self.mark)
                piece = self.mark if byte == 32 else bytes([byte])
                out += piece
                align += [origin] * len(piece)
                blank = self.squeeze and byte == 32
            at += length
        end = len(source)
        while self.squeeze and out.endswith(self.mark):
            end = align[-len(self.mark)]
            del out[-len(self.mark) :], align[-len(self.mark) :]
        if self.suffix and self.dummy and out:
            out += self.mark
            align += [end] * len(self.mark)
        return bytes(out), np.array([*align, end], dtype=np.int64)


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


class Encoder:
    """Encode and decode whole texts with one model."""

    def __init__(self, model: bytes, eos: bool = True) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        lone = all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", p.piece) for p in proto.pieces) and any(p.piece == SPACE for p in proto.pieces)
        self.cut = lone and proto.normalizer_spec.escape_whitespaces
        kinds = proto.SentencePiece
        self.names = [str(k) for k in range(len(proto.pieces))]
        self.unknown = next((k for k, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), -1)
        self.lengths = np.array([0 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.bytes = np.array([int(p.piece[3:5], 16) if p.type == kinds.BYTE else -1 for p in proto.pieces], dtype=np.int64)
        spec = proto.normalizer_spec
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.end = [self.library.eos_id()] if eos else []
        self.seen: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        if not self.cut:
            return [text] if text else []
        if text[:1] == SPACE and SPACE + SPACE not in text and text[-1:] != SPACE:
            return [SPACE + w for w in text[1:].split(SPACE)]
        return WORDS.findall(text)

    def _segment(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of normalised texts. New words of all of them go to the segmenter at once."""
        parts = [self._words(t) for t in texts]
        new = list({w for words in parts for w in words if w not in self.seen})
        fresh = {w: np.array(ids, dtype=np.int32).tobytes() for w, ids in zip(new, self.segmenter.encode(new, out_type=int, num_threads=1))} if new else {}
        room = SEEN - len(self.seen)
        if room > 0:
            self.seen.update(list(fresh.items())[:room] if len(fresh) > room else fresh)
        known = self.seen if len(fresh) <= max(room, 0) else {**{w: self.seen[w] for words in parts for w in words if w in self.seen}, **fresh}
        for words in parts:
            yield np.frombuffer(b"".join([known[w] for w in words]), dtype=np.int32)

    def _widths(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes under each piece; the last byte piece of a character has all of it."""
        if self.unknown in ids:
            return np.array([len(p.encode()) for p in self.segmenter.encode(text, out_type=str)], dtype=np.int64)
        widths, values = self.lengths[ids], self.bytes[ids]
        leads = np.flatnonzero((values >= 0) & (values & 0xC0 != 0x80))
        if len(leads):
            lead = values[leads]
            size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            widths[leads + size - 1] = size
        return widths

    def encode(self, texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(ids, begins, ends)`` of each text; spans are bytes of the original."""
        normal = [self.normalize(t) for t in texts]
        plain = [data.decode(errors="replace") for data, _ in normal]
        for source, (_, align), text, ids in zip(texts, normal, plain, self._segment(plain)):
            widths = self._widths(text, ids)
            ends = np.cumsum(widths)
            tail = np.full(len(self.end), len(source), dtype=np.int64)
            ids = np.concatenate([ids, np.array(self.end, dtype=np.int32)])
            yield ids, np.concatenate([align[ends - widths], tail]), np.concatenate([align[ends], tail])

    def decode(self, ids: Sequence[int]) -> str:
        return self.library.decode(ids)


def _groups(texts: Iterator[bytes], most: int) -> Iterator[list[bytes]]:
    """Runs of texts of about ``most`` bytes."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


TYPES = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "begins": ("array<int>", pa.list_(pa.int32())),
    "ends": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "n_tokens": ("bigint", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
    "span_bytes": ("bigint", pa.int64()),
}


def _values(encoder: Encoder, names: Sequence[str], one: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple:
    ids, begins, ends = one
    plain = ids.tolist()
    decoded = encoder.decode(plain) if {"decoded", "decoded_sha256"} & set(names) else None
    make = {
        "ids": lambda: ids,
        "begins": lambda: begins,
        "ends": lambda: ends,
        "decoded": lambda: decoded,
        "n_tokens": lambda: len(ids),
        "ids_sha256": lambda: hashlib.sha256(" ".join([encoder.names[i] for i in plain]).encode()).hexdigest(),
        "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest(),
        "span_bytes": lambda: int((ends - begins).sum()),
    }
    return tuple(make[n]() for n in names)


def encode(docs: DataFrame, model: str, text_col: str = "text", carry: Sequence[str] = ("doc_id",), results: Sequence[str] = ("ids", "begins", "ends"), eos: bool = True) -> DataFrame:
    """The columns in ``carry`` and the ``results`` of encoding ``text_col``.

    ``results`` are names of ``TYPES``: ids, byte spans of their pieces in the
    original text, the decoded text, counts and digests. Digests are SHA-256 of
    the decimal ids joined by one space, and of the decoded text in UTF-8;
    ``span_bytes`` adds up the lengths of all spans. A NULL text is empty and
    gives the end id alone, or no id. Repeated rows give repeated results. A
    carried column named like a result gives way to it. ``model`` is a file that
    the driver reads; its bytes are broadcast, and their size does not depend on
    the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    carry = [c for c in carry if c.lower() not in {r.lower() for r in results}]
    names = list(results)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, eos)
        for batch in batches:
            first = 0
            for group in _groups((v.as_py() or b"" for v in batch.column(len(carry)).cast(pa.large_binary())), GROUP):
                found = zip(*(_values(encoder, names, one) for one in encoder.encode(group)))
                columns = [pa.array(c, TYPES[n][1]) for n, c in zip(names, found)]
                kept = [batch.column(k).slice(first, len(group)) for k in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*carry, *names])
                first += len(group)

    picked = docs.select(*carry, F.col(text_col).cast("string").cast("binary").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    return picked.mapInArrow(scan, ", ".join([*fields, *(f"{n} {TYPES[n][0]}" for n in names)]))


def decode(rows: DataFrame, model: str, ids_col: str = "ids", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry`` and the text that ``ids_col`` stands for; NULL ids give NULL."""
    shared = rows.sparkSession.sparkContext.broadcast(model_bytes(model))
    carry = [c for c in carry if c.lower() != "decoded"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column(len(carry)).to_pylist()]
            kept = [batch.column(k) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*carry, "decoded"])

    picked = rows.select(*carry, F.col(ids_col).cast("array<int>").alias("_ids"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    return picked.mapInArrow(scan, ", ".join([*fields, "decoded string"]))
