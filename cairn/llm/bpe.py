"""Byte-level BPE encoding and decoding, exact to the tokenizers library.

``Codec`` encodes one text: it splits it as the tokenizer file's byte-level pre-tokenizer does, looks each piece up in a
bounded cache and encodes unseen pieces by the file's own ranks. Texts with characters that became letters or numbers
after Unicode 3.2, or are still unassigned, go to the library whole, so that its own tables decide.

``encode_documents`` is the operator. Long texts are cut into leaves that are encoded in parallel on Spark; then the
leaves of a document are joined as a tree. A join re-encodes a growing window around the cut until the window starts as
the left side does and ends as the right side does:

* pieces: the scan from a piece boundary depends on what follows it only, so once the window's scan meets a boundary of
  the right side, all pieces after it are the right side's;
* tokens of one piece: a token sequence is the BPE encoding of its bytes exactly if each pair of neighbours encodes to
  itself, so a window that begins with the left side's token and ends with the right side's gives an exact sequence.

Nulls encode as the empty text (no ids). Extra input columns are ignored but for those named in ``keep``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of a worker's piece cache; it is emptied when full.
CACHE_ENTRIES = 100_000
#: Code points of a leaf of a long text, and mapped bytes of a piece that is encoded in halves.
LEAF_CHARS = 32_768
LONG_PIECE = 2_048


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


ALPHABET = _byte_alphabet()


#: Code points up to which characters are classed here; no letters or numbers lie beyond.
LAST = 0x40000


def _char_class(test, last: int = LAST) -> str:
    """The inside of a character class with the characters below ``last`` for which test holds."""
    out, start = [], None
    for c in range(last + 1):
        inside = c < last and not 0xD800 <= c <= 0xDFFF and test(chr(c))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, encode):
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self._encode(piece)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class Codec:
    """Encodes and decodes texts with a byte-level BPE tokenizer file."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(tokenizer_path)
        self._tok.no_padding()
        self._tok.no_truncation()
        self.specials = {t.content: i for i, t in self._tok.get_added_tokens_decoder().items()}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        old, new = (lambda c: unicodedata.ucd_3_2_0.category(c)[0]), (lambda c: unicodedata.category(c)[0])
        # fixed: the White_Space property
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        # letters or numbers in one version of Unicode and not in another; what is no letter or number in either, like emoji, splits alike
        changed = lambda c: (new(c) in "LN" or old(c) in "LN") and old(c) != new(c) or unicodedata.category(c) == "Cn"

        def pattern(last: int) -> re.Pattern:
            letter, number = (_char_class(lambda c, k=k: new(c) == k, last) for k in "LN")
            return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")

        # classes of the first 65,536 characters are tables, of all they are lists of ranges: few texts need the second
        self._beyond = re.compile("[\U00010000-\U0010ffff]")
        self._odd_here = re.compile(f"[{_char_class(changed, 0x10000)}\ud800-\udfff]")
        self._odd_beyond = re.compile(f"[{_char_class(lambda c: c > '\uffff' and changed(c))}{chr(LAST)}-\U0010ffff]")
        self._split, self._split_all = pattern(0x10000), None
        self._pattern = pattern
        self._ranked = self._rank_encoder()
        self._pieces = _Pieces(self._encode_piece)

    def odd(self, text: str) -> bool:
        """Whether a text has characters that the library must class."""
        return not text.isascii() and bool(self._odd_here.search(text) or (self._beyond.search(text) and self._odd_beyond.search(text)))

    def split(self, text: str) -> list[str]:
        """The pieces of a text without odd characters and special strings."""
        if text.isascii() or not self._beyond.search(text):
            return self._split.findall(text)
        if self._split_all is None:
            self._split_all = self._pattern(LAST)
        return self._split_all.findall(text)

    # tables of long pieces and of decoding, made when first used
    @cached_property
    def _model(self):
        from tokenizers import Tokenizer

        return Tokenizer(self._tok.model)  # merges alone, on mapped bytes

    @cached_property
    def _token(self) -> dict[int, str]:
        return {i: t for t, i in self._tok.get_vocab().items()}

    @cached_property
    def _raw(self) -> dict[bytes, bytes]:
        raw = {c: b for b, c in enumerate(ALPHABET)}
        return {struct.pack("<I", i): bytes(raw[c] for c in t) if i not in self.specials.values() else t.encode() for i, t in self._token.items()}

    def _rank_encoder(self):
        """An encoder of one piece from this file's own vocabulary, where ids follow the order of the merges (they then
        are ranks); None where they don't, and the library encodes each piece."""
        import json

        import tiktoken

        model = json.loads(self._tok.to_str())["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")):
            return None
        made = [model["vocab"].get(m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)) for m in model["merges"]]
        if None in made or any(a >= b for a, b in zip(made, made[1:], strict=False)) or len(made) + 256 != len(set(model["vocab"]) - set(self.specials)):
            return None
        raw = {c: b for b, c in enumerate(ALPHABET)}
        ranks = {bytes(raw[c] for c in t): i for t, i in model["vocab"].items() if t not in self.specials}
        return tiktoken.CoreBPE(ranks, {}, ".").encode_single_piece if hasattr(tiktoken, "CoreBPE") else tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    # encoding -------------------------------------------------------------------------------------------------------
    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text, packed."""
        if not text:
            return b""
        if self.odd(text):
            return self.pack(self._tok.encode(text, add_special_tokens=False).ids)
        return b"".join(self._pack_parts(text))

    def _pack_parts(self, text: str) -> Iterator[bytes]:
        get = self._pieces.__getitem__
        if self._special and any(s in text for s in self.specials):
            for part in self._special.split(text):
                if part in self.specials:
                    yield self.pack([self.specials[part]])
                else:
                    yield from map(get, self.split(part))
        else:
            yield from map(get, self.split(text))

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        if len(data) <= LONG_PIECE:
            return self._ranked(data) if self._ranked else self._tok.encode(piece, add_special_tokens=False).ids
        return self._halves("".join(map(ALPHABET.__getitem__, data)))

    def _halves(self, mapped: str) -> list[int]:
        if len(mapped) <= LONG_PIECE:
            return self._model.encode(mapped, add_special_tokens=False).ids
        cut = len(mapped) // 2
        return self.join_tokens(self._halves(mapped[:cut]), self._halves(mapped[cut:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of one piece from those of its two parts."""
        width = 4
        while left and right:
            a, b = min(width, len(left)), min(width, len(right))
            window = self._model.encode("".join(self._token[i] for i in left[-a:] + right[:b]), add_special_tokens=False).ids
            agreed_left = a == len(left) or window[0] == left[-a]
            agreed_right = b == len(right) or window[-1] == right[b - 1]
            if agreed_left and agreed_right:
                return left[: len(left) - a] + window + right[b:]
            width *= 2
        return left or right

    # leaves of a long text -------------------------------------------------------------------------------------------
    def leaf(self, text: str) -> tuple[list[str], list[bytes]]:
        """The pieces of a part of a text and their packed ids. Special strings are kept out of leaves by the cutter."""
        pieces = self.split(text)
        return pieces, list(map(self._pieces.__getitem__, pieces))

    def join(self, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        """The pieces of two neighbouring parts, as if scanned together."""
        (lp, li), (rp, ri) = left, right
        if not lp or not rp:
            return (lp + rp, li + ri)
        width = 4
        while True:
            a, b = min(width, len(lp)), min(width, len(rp))
            head, tail = lp[len(lp) - a :], rp[:b]
            text = "".join(head) + "".join(tail)
            scan, end, ends, at = self.split(text), len(text), set(), len(text) - sum(map(len, tail))
            for p in tail:
                at += len(p)
                ends.add(at)
            agreed_left, keep, stop, at = a == len(lp) or scan[0] == head[0], None, 0, 0
            cut = len(text) - sum(map(len, tail))
            for k, p in enumerate(scan):
                at += len(p)
                # a boundary holds if the window shows all that the scan may look at behind it
                if at >= cut and (at in ends) and (at <= end - 4 or b == len(rp)):
                    keep, stop = k + 1, at
                    break
            if agreed_left and keep is not None:
                break
            if a == len(lp) and b == len(rp):
                keep, stop = len(scan), end
                break
            width *= 2
        skip, at = 0, cut
        while at < stop:
            at += len(rp[skip])
            skip += 1
        known = {lp[-1] + rp[0]: (li[-1], ri[0])}
        middle = []
        for p in scan[:keep]:
            if len(p) > LONG_PIECE and p in known:
                one, two = (list(struct.unpack(f"<{len(x) // 4}I", x)) for x in known[p])
                middle.append(self.pack(self.join_tokens(one, two)))
            else:
                middle.append(self._pieces[p])
        return lp[: len(lp) - a] + scan[:keep] + rp[skip:], li[: len(li) - a] + middle + ri[skip:]

    def join_tree(self, parts: list[tuple[list[str], list[bytes]]]) -> bytes:
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return b"".join(parts[0][1]) if parts else b""

    def cuttable(self, text: str) -> bool:
        """Whether a text may be cut into leaves: no special strings, and no characters that the library must class."""
        return not self.odd(text) and not any(s in text for s in self.specials)

    # decoding -------------------------------------------------------------------------------------------------------
    def decode(self, packed: bytes) -> str:
        raw = self._raw
        return b"".join([raw[packed[k : k + 4]] for k in range(0, len(packed), 4)]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(tokenizer_path: str) -> Codec:
    """This process's codec of a tokenizer file."""
    if tokenizer_path not in _CODECS:
        _CODECS[tokenizer_path] = Codec(tokenizer_path)
    return _CODECS[tokenizer_path]


# Spark --------------------------------------------------------------------------------------------------------------
DIGEST_SCHEMA = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def packed_digests(c: Codec, packed: bytes) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids joined by commas, and SHA-256 of the decoded text."""
    ids = struct.unpack(f"<{len(packed) // 4}I", packed)
    text = c.decode(packed)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def _finish(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(col), f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def encode_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row per input row: ``key`` and ``ids`` (packed little-endian unsigned 32-bit numbers).

    Short texts are encoded where they are. Texts of more than ``leaf_chars`` code points are cut, their leaves are
    spread over the cluster and encoded, and come together again by document: a group is one document's leaves, no more
    than its row. Null text: no ids. Repeated rows and null keys keep a row each.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kt = rows.schema["k"].dataType
    out_type = T.StructType([T.StructField(key, kt), T.StructField("ids", T.BinaryType())])
    out_arrow = to_arrow_schema(out_type)

    def whole(batches):
        c = codec(tokenizer_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t.as_py()) for t in b.column(1)], pa.binary())], schema=out_arrow)

    long = F.length("t") > leaf_chars
    short = rows.where(~F.coalesce(long, F.lit(False))).mapInArrow(whole, out_type)
    leaf_type = T.StructType([T.StructField("row", T.LongType()), T.StructField("k", kt), T.StructField("leaf", T.IntegerType()), T.StructField("t", T.StringType()), T.StructField("whole", T.BooleanType())])
    leaf_arrow = to_arrow_schema(leaf_type)

    def cut(batches):
        c = codec(tokenizer_path)
        for b in batches:
            for row, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = t.as_py()
                step = leaf_chars if c.cuttable(t) else len(t)
                yield _finish([(row, k, n, t[at : at + step], step == len(t)) for n, at in enumerate(range(0, len(t), step))], leaf_arrow)

    part_type = T.StructType([T.StructField("row", T.LongType()), T.StructField("k", kt), T.StructField("leaf", T.IntegerType()), T.StructField("lengths", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("t", T.StringType())])
    part_arrow = to_arrow_schema(part_type)

    def encode(batches):
        c = codec(tokenizer_path)
        for b in batches:
            for row, k, n, t, is_whole in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if is_whole:
                    yield _finish([(row, k, n, None, None, c.encode(t), None)], part_arrow)
                else:
                    pieces, ids = c.leaf(t)
                    yield _finish([(row, k, n, c.pack(list(map(len, pieces))), c.pack([len(x) for x in ids]), b"".join(ids), t)], part_arrow)

    def join(table: pa.Table) -> pa.Table:
        c = codec(tokenizer_path)
        parts, packed = [], None
        table = table.sort_by("leaf")
        for r in table.to_pylist():
            if r["lengths"] is None:
                packed = r["ids"]
                continue
            pieces, ids, at, to = [], [], 0, 0
            for n, m in zip(*(struct.unpack(f"<{len(r[x]) // 4}I", r[x]) for x in ("lengths", "counts")), strict=True):
                pieces.append(r["t"][at : at + n])
                ids.append(r["ids"][to : to + m])
                at, to = at + n, to + m
            parts.append((pieces, ids))
        return pa.table([table.column("k").slice(0, 1).combine_chunks(), pa.array([packed if packed is not None else c.join_tree(parts)], pa.binary())], schema=out_arrow)

    leaves = rows.where(long).select(F.monotonically_increasing_id().alias("row"), "k", "t").mapInArrow(cut, leaf_type)
    joined = leaves.repartition("row", "leaf").mapInArrow(encode, part_type).groupBy("row").applyInArrow(join, out_type)
    return short.unionByName(joined)


def decode_digests(encoded: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of packed ids."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out_type = T.StructType([T.StructField(key, encoded.schema[key].dataType), *DIGEST_SCHEMA.fields])
    out_arrow = to_arrow_schema(out_type)

    def digest(batches):
        c = codec(tokenizer_path)
        for b in batches:
            yield _finish([(k.as_py(), *packed_digests(c, packed.as_py())) for k, packed in zip(b.column(0), b.column(1), strict=True)], out_arrow)

    return encoded.select(key, ids).mapInArrow(digest, out_type)
