"""BPE encoding of whole texts, and encoding by tree concatenation.

`Encoder` gives the ids of `tokenizers` for the two kinds of vocabulary file used here
(byte-level BPE; lower-cased BPE with word ends). A text is cut where no token can cross
(`pieces`). Plain texts and pieces go through the merge core of tiktoken with the merges of
the same file; others through `tokenizers`, with a bounded memo of pieces.

Tree concatenation: a long text is cut in halves again and again, without regard to words;
leaves are encoded in parallel, then joined pairwise. At a join, the last piece of the left
and the first piece of the right are one piece of the whole text; it is encoded anew, and the
window grows over further pieces until both sides agree with it. A piece that is itself long
(no blank in it) is joined on the level of tokens: a growing window around the join is
encoded until its first and last tokens equal, in place and id, those of both sides.

Defined cases: null texts are empty and give no ids; special tokens written in a text become
special ids, as in the library; repeated rows are each encoded; other columns are kept.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The splitter of byte-level vocabularies, letters and digits of Latin-1.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"

#: Pieces in the memo of one worker (about 20 MB).
MEMO = 100_000
#: Characters of a leaf; pieces longer than PIECE are encoded by tree concatenation.
LEAF, PIECE = 32_768, 2_048


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.specials = [x["content"] for x in spec["added_tokens"]]
        chars, ranks = _byte_chars(), {}
        names = {x["id"] for x in spec["added_tokens"]}
        # A blank stands for the end of a word: no word has one.
        for token, k in spec["model"]["vocab"].items():
            if k not in names:
                end = self.suffix and token.endswith(self.suffix)
                ranks[bytes(chars[c] for c in (token[: -len(self.suffix)] if end else token)) + (b" " if end else b"")] = k
        own = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.core = tiktoken.Encoding("own", pat_str="[^ ]+ " if self.suffix else _BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={} if self.suffix else own)
        # Texts of Latin-1 characters need no context for lower case and normal form C.
        self.odd = re.compile("[^\t-\r -~\u00a1-\u00ff]")
        self.runs = re.compile(f"[.,][^\\s{_LETTERS}{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}][.,]")
        self.rest = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^\\s.,{_LETTERS}{_DIGITS}]+")
        self.merge = self.core._core_bpe.encode_single_piece
        self.marks = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
        self.memo: dict[str, bytes] = {}

    @functools.cached_property
    def tokenizer(self):
        """The library's tokenizer, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        found = Tokenizer.from_file(self.path)
        found.no_padding()
        found.no_truncation()
        return found

    # -- one piece

    def whole(self, text: str) -> list[int]:
        """The library's own ids."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def words(self, text: str) -> list[str] | None:
        """The words that the splitter of a vocabulary with word ends makes of a Latin-1 text, None for others."""
        if self.odd.search(text) or any(s in text for s in self.specials):
            return None
        text = text.lower()
        if not self.runs.search(text):  # full stops and commas stand alone
            text = text.replace(".", " . ").replace(",", " , ")
            return (self.rest.sub(r" \g<0> ", text) if self.rest.search(text) else text).split()
        return self.marks.sub(r" \g<0> ", text).split()

    def fresh(self, piece: str) -> bytes:
        """Ids of a piece that is not in the memo."""
        if len(piece) > PIECE:
            return np.array(tree_piece(self, piece), "<u4").tobytes()
        if not self.suffix:
            return array("I", self.core.encode(piece, allowed_special="all")).tobytes()
        found = self.words(piece)
        if found is None:
            return array("I", self.whole(piece)).tobytes()
        return b"".join([array("I", self.merge(w.encode() + b" ")).tobytes() for w in found])

    def word(self, word: str) -> bytes:
        if len(word) > PIECE:
            return np.array(tree_piece(self, word), "<u4").tobytes()
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = got = array("I", self.merge(word.encode() + b" ")).tobytes()
        return got

    def of(self, piece: str) -> bytes:
        memo = self.memo
        got = memo.get(piece)
        if got is None:
            got = self.fresh(piece)
            if len(piece) <= 64:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[piece] = got
        return got

    # -- whole texts

    def pieces(self, text: str) -> list[str]:
        """Parts whose ids, one after the other, are those of the text."""
        if self.suffix:
            return text.replace("\n", " ").split(" ")
        if re.search(r"\s ", text):
            return re.split(r"(?<=\S)(?= )", text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        memo = self.memo
        if self.suffix and (words := self.words(text)) is not None:
            got = [*map(memo.get, words)]
            if None in got:
                word = self.word
                got = [word(w) if g is None else g for g, w in zip(got, words, strict=True)]
            return b"".join(got)
        if not self.suffix and len(max(text.split(" "), key=len)) <= PIECE:
            if any(s in text for s in self.specials):
                return array("I", self.core.encode(text, allowed_special="all")).tobytes()
            return array("I", self.core.encode_ordinary(text)).tobytes()
        return b"".join([memo.get(p) or self.of(p) for p in self.pieces(text)])

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# -- tree concatenation within one unbroken piece


def _tokens(enc: Encoder, text: str, at: int) -> list[tuple[int, int, int]]:
    """(id, first character, character after) of each token; `at` is where text begins."""
    e = enc.tokenizer.encode(text, add_special_tokens=False)
    return [(k, at + a, at + b) for k, (a, b) in zip(e.ids, e.offsets, strict=True)]


def _join(enc: Encoder, text: str, lo: int, left: list, right: list, hi: int) -> list:
    """Tokens of text[lo:hi] from those of its two parts: windows around the join grow until both sides agree."""
    reach = 16
    while True:
        a = max(0, len(left) - reach)
        b = min(len(right), reach)
        start = lo if a == 0 else left[a][1]
        end = hi if b == len(right) else right[b - 1][2]
        window = _tokens(enc, text[start:end], start)
        # Half of the window on each side must come out as before: then the rest cannot differ.
        keep_l = 0 if a == 0 else max(1, reach // 2)
        keep_r = 0 if b == len(right) else max(1, reach // 2)
        if len(window) >= keep_l + keep_r and window[:keep_l] == left[a : a + keep_l] and (not keep_r or window[-keep_r:] == right[b - keep_r : b]):
            return left[:a] + window + right[b:]
        if a == 0 and b == len(right):
            return window
        reach *= 2


def tree_piece(enc: Encoder, piece: str) -> list[int]:
    """Ids of one long piece by tree concatenation."""
    if any(s in piece for s in enc.specials):
        return enc.whole(piece)

    def build(lo: int, hi: int) -> list:
        if hi - lo <= PIECE // 2:
            return _tokens(enc, piece[lo:hi], lo)
        mid = (lo + hi) // 2
        return _join(enc, piece, lo, build(lo, mid), build(mid, hi), hi)

    return [k for k, _, _ in build(0, len(piece))]


# -- tree concatenation of documents over tasks


def _cut(enc: Encoder, text: str, last: bool) -> tuple[str, str]:
    """(rest, edge piece) at one end of a leaf; rest is empty if the leaf has no safe cut."""
    if enc.suffix:
        found = [k for k in (text.rfind(x) if last else text.find(x) for x in " \n") if k >= 0]
        if not found:
            return "", text
        k = max(found) if last else min(found)
        return (text[: k + 1], text[k + 1 :]) if last else (text[k:], text[:k])
    cuts = [m.start() for m in re.finditer(r"(?<=\S)(?= \S)", text)]
    if not cuts:
        return "", text
    return (text[: cuts[-1]], text[cuts[-1] :]) if last else (text[cuts[0] :], text[: cuts[0]])


def concatenate(enc: Encoder, a: tuple[str, bytes], b: tuple[str, bytes]) -> tuple[str, bytes]:
    """(text, ids) of a joined text from those of its two parts."""
    (ta, ia), (tb, ib) = a, b
    if not ta or not tb:
        return (ta + tb, ia + ib)
    reach = PIECE
    while True:  # the window grows until it ends at safe cuts and both sides agree with it
        rest_a, edge_a = _cut(enc, ta[-reach:], True)
        rest_b, edge_b = _cut(enc, tb[:reach], False)
        whole_a, whole_b = reach >= len(ta), reach >= len(tb)
        if whole_a and whole_b and not (rest_a and rest_b):
            return ta + tb, enc.encode(ta + tb)
        safe = reach > PIECE or not any(s[:1] in edge_a + edge_b for s in enc.specials)
        if safe and (rest_a or whole_a) and (rest_b or whole_b):
            left, right = enc.encode(edge_a), enc.encode(edge_b)
            if ia.endswith(left) and ib.startswith(right):
                return ta + tb, ia[: len(ia) - len(left)] + enc.encode(edge_a + edge_b) + ib[len(right) :]
            if whole_a and whole_b:
                return ta + tb, enc.encode(ta + tb)
        reach *= 4


def tree(enc: Encoder, leaves: list[tuple[str, bytes]]) -> bytes:
    """Ids of a document from its encoded leaves, joined pairwise, level by level."""
    while len(leaves) > 1:
        leaves = [concatenate(enc, leaves[k], leaves[k + 1]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0][1] if leaves else b""


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): ids of every whole text as little-endian unsigned 32-bit integers.

    Texts of up to LEAF characters are encoded where they are read. Longer ones are cut into
    leaves, dealt out over the cluster, encoded in parallel and joined per document.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def short(batches):
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(ids, pa.binary())], ["_id", "ids"])

    kind = dict(base.dtypes)["_id"]
    near = base.where(F.length("_text") <= LEAF).mapInArrow(short, f"_id {kind}, ids binary")
    cut = base.where(F.length("_text") > LEAF).withColumn("_row", F.monotonically_increasing_id())
    parts = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{LEAF}}}"), F.lit(0))  # one pass, however long the text
    leaves = cut.select("_id", "_row", F.posexplode(parts).alias("k", "leaf"))

    def leaf(batches):
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode(t) for t in b.column("leaf").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], [*b.schema.names, "ids"])

    # The id of a row follows its task; the leaves' shuffle is read by one job only.
    dealt = leaves.repartition("_row", "k").mapInArrow(leaf, f"_id {kind}, _row long, k int, leaf string, ids binary")

    def whole(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["k", "leaf", "ids"]).to_pylist(), key=lambda r: r["k"])
        ids = tree(encoder(path), [(r["leaf"], r["ids"]) for r in rows])
        return pa.table({"_id": group.column("_id").slice(0, 1), "ids": pa.array([ids], pa.binary())})

    far = dealt.groupBy("_row").applyInArrow(whole, f"_id {kind}, ids binary")
    return near.unionByName(far).withColumnRenamed("_id", id_col)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded string): the ids of every text and the text decoded from them."""
    kind = dict(docs.dtypes)[id_col]

    def back(batches):
        enc = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = enc.decode_batch([np.frombuffer(x, "<u4").tolist() for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [id_col, "ids", "decoded"])

    return encode(docs, path, id_col, text_col).mapInArrow(back, f"{id_col} {kind}, ids binary, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(F.col(id_col), F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
