"""BPE encoding and decoding with word ends by tree concatenation (operator 13).

The vocabulary splits a text into pieces (runs of letters, single figures, runs of other characters) and never merges across
them or across white space. Words between ASCII white space are therefore encoded once each and kept in a bounded cache.

Text that isn't split may be long. It is cut into leaves, leaves are encoded apart, and neighbours are joined two by two: the last
``k`` ids before a join and the first ``k`` after it are encoded again as one string, for k = 1, 2, 4, ..., until the new ids begin
with the left window's first id and end with the right window's last one. Merges go by rank, the leftmost first, so a row of ids
is the encoding of its text if and only if every two neighbours are the encoding of theirs; the pairs inside the window are so by
its encoding, those outside by the encodings of the two sides, and the pairs at its edges because both sides agree there. The result
is exactly that of the whole text.

Leaves end at white space if there is some near, else between two figures, else inside a run of letters or of other characters
(``_INSIDE``): there the left leaf's last piece is encoded without the mark for word ends, and the join's windows stay inside the
piece. Where a long stretch has no such place (an unusual script), it stays one leaf.

Scale: texts up to ``LONG`` characters are encoded where they are read, no shuffle. Longer ones are cut into spans of ``SPAN``
characters that all tasks encode, distinct texts once; spans of one text meet in levels of ``FAN`` neighbours, so a level's
task holds the ids of so many spans and only the last the ids of one text, as numbers.

Defined results: a null or empty text has no ids and decodes to the empty text; the string of an added token is that token, as
the library does by default; repeated rows are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CACHES, materialize, partitions, small_batches, text_or_empty

LEAF, SPAN, LONG, FAN = 2048, 1 << 18, 1 << 20, 8

_WHITE = re.compile(r"[\t-\r ]")
#: Letters that start a character, keep their number when lower-cased and join with nothing before them.
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ɏΑ-ΡΣ-ωА-яぁ-ゖァ-ヺ一-鿿가-힣"
#: Signs that neither begin a contraction nor an added token.
_SIGN = r'!"#$%&()*+,\-./:;=?@\[\\\]^_`{}~'
#: Inside a run: four characters of it before, one after, so that no contraction reaches over the cut.
_INSIDE = re.compile(rf"(?<=[{_LETTER}]{{4}})(?=[{_LETTER}])|(?<=[{_SIGN}]{{4}})(?=[{_SIGN}])")
_FIGURES = re.compile("(?<=[0-9])(?=[0-9])")


@dataclass
class Part:
    """Ids of a stretch of text. If its first (last) piece goes on before (after) it, head (tail) is that piece's number of ids."""

    ids: list[int]
    before: bool = False
    after: bool = False
    head: int = 0
    tail: int = 0


class WordBPE:
    """text -> ids and back, as the library does with a vocabulary that marks word ends."""

    def __init__(self, path: str, leaf: int = LEAF, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.leaf, self.most = leaf, most
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.suffix = described["model"]["end_of_word_suffix"] or ""
        described["model"]["end_of_word_suffix"] = None
        self.closed, self.open = self.library.model, Tokenizer.from_str(json.dumps(described)).model
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = {content: self.library.token_to_id(content) for content in added}
        self._apart = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self._known: dict[bytes, tuple[int, bytes, bytes]] = {}

    # Encoding

    def cut(self, text: str, start: int, size: int) -> tuple[int, bool]:
        """(end, whether that is inside a piece) of the leaf that begins at start: about ``size`` characters, the rest if there is no place to cut."""
        reach = start + size
        if reach >= len(text):
            return len(text), False
        while reach < len(text):
            low, high = reach - size // 2, min(reach + size // 2, len(text))
            for pattern, inside in ((_WHITE, False), (_FIGURES, False), (_INSIDE, True)):
                for found in pattern.finditer(text, low, high):
                    if not self._in_added(text, found.start()):
                        return found.start(), inside
            reach = high + size // 2
        return len(text), False

    def _in_added(self, text: str, place: int) -> bool:
        for content in self.added:
            near = text.find(content, max(0, place - len(content) + 1), place + len(content) - 1)
            if near >= 0:
                return True
        return False

    def leaves(self, text: str, size: int) -> list[tuple[str, bool, bool]]:
        """(stretch, goes on before it, goes on after it): the whole text in order."""
        out, start, before = [], 0, False
        while start < len(text):
            end, after = self.cut(text, start, size)
            out.append((text[start:end], before, after))
            start, before = end, after
        return out

    def _pieces(self, text: str) -> list[str | int]:
        """The pieces of a stretch in the vocabulary's characters; an added token is its id."""
        out = []
        for part in self._apart.split(text) if self._apart else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out.extend(piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)))
        return out

    def part(self, text: str, before: bool = False, after: bool = False) -> Part:
        """The ids of a stretch, halves first where it is long and not split."""
        words = [w for w in _WHITE.split(text) if w]
        if len(words) == 1:
            (word,) = words
            if len(word) <= self.leaf:
                return self._leaf(word, before, after)
            found = self.leaves(word, self.leaf // 2)
            if len(found) == 1:
                return self._leaf(word, before, after)
            found[0], found[-1] = (found[0][0], before, found[0][2]), (*found[-1][:2], after)
            parts = [self.part(*stretch) for stretch in found]
            return self.tree(parts)
        parts = []
        for i, word in enumerate(words):
            first, last = before and not i, after and i == len(words) - 1
            parts.append(self.part(word, first, last) if first or last or len(word) > self.leaf else Part(self.library.encode(word, add_special_tokens=False).ids))
        if not parts:
            return Part([])
        ids = [i for p in parts for i in p.ids]
        return Part(ids, before, after, parts[0].head, parts[-1].tail)

    def _leaf(self, text: str, before: bool, after: bool) -> Part:
        if not before and not after:
            return Part(self.library.encode(text, add_special_tokens=False).ids)
        pieces, found = self._pieces(text), []
        for i, piece in enumerate(pieces):
            model = self.open if after and i == len(pieces) - 1 else self.closed
            found.append([piece] if isinstance(piece, int) else [t.id for t in model.tokenize(piece)])
        return Part([i for ids in found for i in ids], before, after, len(found[0]) if before else 0, len(found[-1]) if after else 0)

    def tree(self, parts: list[Part]) -> Part:
        """Neighbours joined two by two until one is left."""
        while len(parts) > 1:
            joined = [self.joined(a, b) for a, b in zip(parts[::2], parts[1::2], strict=False)]
            parts = joined + parts[len(parts) - len(parts) % 2 :]
        return parts[0]

    def joined(self, a: Part, b: Part) -> Part:
        if not a.after:
            return Part(a.ids + b.ids, a.before, b.after, a.head, b.tail)
        one = b.head == len(b.ids)
        left, right = a.ids[len(a.ids) - a.tail :], b.ids[: b.head]
        middle = self.bridged(left, right, not (one and b.after))
        ids = a.ids[: len(a.ids) - a.tail] + middle + b.ids[b.head :]
        head = len(middle) if a.tail == len(a.ids) else a.head
        tail = len(middle) if one else b.tail
        return Part(ids, a.before, b.after, head if a.before else 0, tail if b.after else 0)

    def bridged(self, left: list[int], right: list[int], closed: bool) -> list[int]:
        """The ids of one piece from those of its two halves; closed: the right half ends the piece."""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            end = closed and k >= len(right)
            text = "".join(self.tokens[i] for i in a + b)
            new = [t.id for t in (self.closed if end else self.open).tokenize(text.removesuffix(self.suffix) if end else text)]
            if (k >= len(left) or new[0] == a[0]) and (k >= len(right) or new[-1] == b[-1]):
                return left[: max(0, len(left) - k)] + new + right[k:]
            k *= 2

    def encode(self, text: str | None) -> list[int]:
        return self.part(text or "").ids

    # Decoding and digests

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: tokens joined by one space, special ones included."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def _word(self, word: bytes) -> tuple[int, bytes, bytes]:
        ids = self.encode(word.decode())
        found = len(ids), " ".join(map(str, ids)).encode(), self.decode(ids).encode()
        if len(self._known) >= self.most:
            self._known.clear()
        if len(word) < 64:
            self._known[word] = found
        return found

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids in decimal, sha256 of the decoded text)."""
        known, n, numbers, shown = self._known, 0, [], []
        for word in (text or "").encode().split():
            size, ids, decoded = known.get(word) or self._word(word)
            if size:
                n += size
                numbers.append(ids)
                shown.append(decoded)
        return n, sha256(b" ".join(numbers)).hexdigest(), sha256(b" ".join(shown)).hexdigest()

    def digests_of_ids(self, ids: np.ndarray, step: int = 1 << 16) -> tuple[int, str, str]:
        """The same for ids that are known."""
        numbers, shown, between = sha256(), sha256(), b""
        for start in range(0, len(ids), step):
            some = ids[start : start + step].tolist()
            numbers.update(between + " ".join(map(str, some)).encode())
            shown.update(between + self.decode(some).encode())
            between = b" "
        return len(ids), numbers.hexdigest(), shown.hexdigest()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_coders: dict[str, WordBPE] = {}
CACHES.append(_coders)


def coder(path: str) -> WordBPE:
    """One a Python worker and vocabulary: its cache serves all tasks of that worker."""
    if path not in _coders:
        _coders[path] = WordBPE(path)
    return _coders[path]


_PART = "key binary, no long, before boolean, after boolean, head long, tail long, ids binary"
_NAMES = ["key", "no", "before", "after", "head", "tail", "ids"]
_KINDS = [pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]


def _row(key: bytes, no: int, part: Part) -> tuple:
    return key, no, part.before, part.after, part.head, part.tail, np.array(part.ids, "<u4").tobytes()


def _part(row: dict) -> Part:
    return Part(np.frombuffer(row["ids"], "<u4").tolist(), row["before"], row["after"], row["head"], row["tail"])


def long_ids(texts: DataFrame, vocabulary: str, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """texts(key binary, text), keys distinct -> (key, ids): spans encoded by all tasks and joined in levels."""
    spark = texts.sparkSession

    def spans(batches):
        for batch in batches:
            for key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                found = coder(vocabulary).leaves(text, span)
                for i in range(0, len(found), 16):
                    some = found[i : i + 16]
                    values = [[key] * len(some), list(range(i, i + len(some))), *zip(*some, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], ["key", "no", "text", "before", "after"])

    def encode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = _row(row["key"], row["no"], coder(vocabulary).part(row["text"], row["before"], row["after"]))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, _KINDS, strict=True)], _NAMES)

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        out = _row(rows[0]["key"], rows[0]["no"] // fan, coder(vocabulary).tree([_part(r) for r in rows]))
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(out, _KINDS, strict=True)], _NAMES)

    cut = texts.mapInArrow(spans, "key binary, no long, text string, before boolean, after boolean")
    level = materialize(cut.repartition(partitions(spark), "key", "no").mapInArrow(encode, _PART))
    most = level.agg(F.max("no")).first()[0] or 0
    while most:
        level = materialize(level.withColumn("up", F.floor(F.col("no") / fan)).groupBy("key", "up").applyInArrow(lambda table: join(table.drop_columns(["up"])), _PART))
        most //= fan
    return level.select("key", "ids")


def _mapped(docs: DataFrame, short, long, columns: list[str], kinds: list[pa.DataType], schema: str, vocabulary: str, longest: int, span: int, fan: int) -> DataFrame:
    """short(coder, text) and long(coder, ids) give the same columns."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    far = F.length("text") > longest

    def batch_of(first: pa.Array, name: str, found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([first, *(pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds))], [name, *columns])

    def near(batches):
        for batch in batches:
            own = coder(vocabulary)
            yield batch_of(batch[0], "doc_id", [short(own, text) for text in batch[1].to_pylist()])

    def ended(batches):
        for batch in batches:
            own = coder(vocabulary)
            yield batch_of(batch[0], "key", [long(own, np.frombuffer(ids, "<u4")) for ids in batch[1].to_pylist()])

    out = rows.where(~far).mapInArrow(near, f"doc_id long, {schema}")
    keyed = rows.where(far).select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"), "text")
    if keyed.isEmpty():
        return out
    ids = long_ids(keyed.select("key", "text").dropDuplicates(["key"]), vocabulary, span, fan)
    # two mappings of names: a row of a long text meets its text's result
    return out.unionByName(keyed.select("doc_id", "key").join(ids.mapInArrow(ended, f"key binary, {schema}"), "key").drop("key"))


def encode(docs: DataFrame, vocabulary: str | None = None, longest: int = LONG, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """One row a row of docs: doc_id, ids."""
    given = (lambda own, text: (own.encode(text),), lambda own, ids: (ids.tolist(),))
    return _mapped(docs, *given, ["ids"], [pa.list_(pa.int32())], "ids array<int>", vocabulary or default_vocabulary(), longest, span, fan)


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """rows(doc_id, ids) -> doc_id, text."""
    path = vocabulary or default_vocabulary()

    def run(batches, path):
        for batch in batches:
            texts = [coder(path).decode(ids or ()) for ids in batch[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(partial(run, path=path), "doc_id long, text string")


def encoded_digests(docs: DataFrame, vocabulary: str | None = None, longest: int = LONG, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """One row a row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    columns, kinds = ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, WordBPE.digests, WordBPE.digests_of_ids, columns, kinds, schema, vocabulary or default_vocabulary(), longest, span, fan)


def op13_tree_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
