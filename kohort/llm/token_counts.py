"""Token counts without token ids: pieces are counted once per distinct pre-token.

1. The corpus is reduced to its distinct pre-tokens with their frequencies; a tokenizer then counts the
   pieces of each distinct pre-token once and the counts are written as a table.
2. The ``head`` most frequent short pre-tokens are broadcast, a table with a fixed bound. Every document
   is reduced to pre-token frequencies; those in the head are summed in place and only the remaining,
   rare ones are joined with the table by a shuffle. So no key of the join is frequent.

The pre-tokens are those of the tokenizer file's byte-level rule. Texts are cut where that rule always
cuts, before a single space between two other characters, and each piece is cut by the rule itself: by
a regular expression where all characters are below U+0250, by the library elsewhere. Texts with other
white space beside a space or with special tokens are cut as a whole. The strings of
special tokens in a text count as one token each, as the library does by default.

Defined cases: a null text counts as empty and has 0 tokens; repeated rows are counted row by row; a
null id is kept; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, stage
from .words import steps

#: fixed value: the byte-level pre-token rule of the tokenizer file
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: distinct words that the first pass holds in a task, and words and rare pre-tokens that the second remembers
HELD, LEARNT = 250_000, 100_000
#: the most bytes a pre-token of the broadcast head may have
HEAD_BYTES = 48
PLAIN = re.compile(r"[\x00-ɏ]*\Z")
#: after letters these surely begin a pre-token of their own
ENDS = frozenset(".,;:!?")
#: a run of ASCII punctuation between a letter and a space or the end: a pre-token of its own, with no space before it
MARK, LETTER = r"[!-/:-@\[-`{-~]", r"[A-Za-zÀ-ÖØ-öø-ÿ]"
TAIL = re.compile(f"{MARK}(?<={LETTER}{MARK}){MARK}*(?= |\\Z)")
#: begins a word that such a run makes
JOINED = "\x00"
#: other white space beside a space or at an end of the text
UNSURE = re.compile(r"[^\S ](?:(?= |\Z)|(?<= [^\S ])|(?<=\A[^\S ]))")


class PreTokens:
    """Cuts texts into pre-tokens as the tokenizer at ``path`` does."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.rule = regex.compile(RULE)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = frozenset(special)
        self.at_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def words(self, text: str) -> list[str] | None:
        """The text cut at its spaces and before punctuation that ends a word, None where it must be cut as a whole.

        That is where spaces meet, other white space borders on a space or an end, or a special token occurs.
        """
        if "  " in text or JOINED in text or text[0] == " " or text[-1] == " " or UNSURE.search(text) or any(s in text for s in self.special):
            return None
        return TAIL.sub(rf" {JOINED}\g<0>", text).split(" ")

    def after_space(self, word: str) -> list[str]:
        """The pre-tokens of a word of ``words`` other than the first."""
        if word[0] == JOINED:
            return [word[1:]]
        return self.cut(" " + word)

    def cut(self, piece: str) -> list[str]:
        """The pre-tokens of a piece of text without special tokens."""
        if PLAIN.match(piece):
            bare = piece[1:] if piece[:1] == " " else piece
            if bare.isalpha():
                return [piece]
            if bare[:-1].isalpha() and bare[-1] in ENDS:
                return [piece[:-1], piece[-1]]
            return self.rule.findall(piece)
        return [piece[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]

    def whole(self, text: str) -> tuple[int, Counter]:
        """(special tokens, pre-tokens) of a text that is not cut at its spaces."""
        special, found = 0, Counter()
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                special += 1
            elif part:
                found.update(self.cut(part))
        return special, found

    def count(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of each pre-token by the tokenizer's own model."""
        encoded = self.tokenizer.encode_batch_fast(pre_tokens, add_special_tokens=False)
        return [len(e) for e in encoded]


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pre_token, frequency, n_pieces) for every distinct pre-token of the corpus, written as a table."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, first, later, whole = PreTokens(path), Counter(), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            # words leave one by one as their pre-tokens are counted
            for cut, held in ((cutter.cut, first), (cutter.after_space, later)):
                while held:
                    word, n = held.popitem()
                    for pre_token in cut(word):
                        whole[pre_token] += n
            found = pa.RecordBatch.from_arrays(
                [pa.array(whole.keys(), pa.string(), size=len(whole)), pa.array(whole.values(), pa.int64(), size=len(whole))], ["pre_token", "n"]
            )
            whole.clear()
            return found

        for _, texts in steps(batches, 0):
            for value in texts:
                if not value:
                    continue
                value = value.decode()
                words = cutter.words(value)
                if words is None:
                    whole.update(cutter.whole(value)[1])
                else:
                    first[words[0]] += 1
                    later.update(words[1:])
            if len(first) + len(later) + len(whole) > HELD:
                yield flush()
        if first or whole:
            yield flush()
        give_back()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(path)
        for batch in small_batches(batches, 4096):
            n = cutter.count(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32())], ["pre_token", "frequency", "n_pieces"]
            )
        give_back()

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(frequencies, "pre_token string, n long")
    distinct = found.groupBy("pre_token").agg(F.sum("n").alias("frequency"))
    return stage(distinct.mapInArrow(counted, "pre_token string, frequency long, n_pieces int"))


class Tally:
    """Counts the known pieces of texts word by word and names their rare pre-tokens.

    Words are learnt once and forgotten together when more than ``learnt`` of them, or of rare pre-tokens, are held.
    """

    def __init__(self, cutter: PreTokens, counts: dict[str, int], learnt: int = LEARNT):
        self.cutter, self.counts, self.learnt = cutter, counts, learnt
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.known = np.zeros(1024, np.int64)
        # each word has at most a few rare pre-tokens: rare[begin:begin + size]
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.rare: list[int] = []
        self.names: list[str] = []
        self.number: dict[str, int] = {}

    def rare_number(self, pre_token: str) -> int:
        n = self.number.setdefault(pre_token, len(self.names))
        if n == len(self.names):
            self.names.append(pre_token)
        return n

    def learn(self, words: set[str]) -> None:
        first, most = len(self.place), len(self.place) + len(words)
        if most > len(self.known):
            self.known, self.begin, self.size = (np.resize(x, 2 * most) for x in (self.known, self.begin, self.size))
        counts, known, begin = self.counts, [], []
        for word in words:
            begin.append(len(self.rare))
            total = 0
            for part in [" " + word] if word.isalpha() and word.isascii() else self.cutter.after_space(word):
                n = counts.get(part)
                if n is None:
                    self.rare.append(self.rare_number(part))
                else:
                    total += n
            known.append(total)
        self.known[first:most], self.begin[first:most] = known, begin
        self.size[first:most] = np.diff([*begin, len(self.rare)])
        self.place.update(zip(words, range(first, most)))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens known per text), and the rare pre-tokens: text, number, frequency."""
        if max(len(self.place), len(self.names)) > self.learnt:
            self.clear()
        words: list[str] = []
        heads: list[str | None] = []
        until = [0]
        for text in texts:
            cut = self.cutter.words(text) if text else None
            if cut is None:
                heads.append(None)
            else:
                heads.append(cut[0])
                words += cut[1:]
            until.append(len(words))
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            new = [words[i] for i in unseen.tolist()]
            self.learn(set(new))
            at[unseen] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        text_of = np.repeat(np.arange(len(texts)), np.diff(until))
        total = np.bincount(text_of, self.known[at], len(texts)).astype(np.int64)
        size = self.size[at]
        owner = np.repeat(text_of, size)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        rare = np.array(self.rare, np.int64)[np.repeat(self.begin[at], size) + within] if len(within) else within
        apart: list[tuple[int, int, int]] = []
        for i, (text, head) in enumerate(zip(texts, heads, strict=True)):
            if not text:
                continue
            if head is None:
                special, found = self.cutter.whole(text)
                total[i] += special
            else:
                found = Counter(self.cutter.cut(head))
            for p, n in found.items():
                if p in self.counts:
                    total[i] += n * self.counts[p]
                else:
                    apart.append((i, self.rare_number(p), n))
        own, number, times = np.array(apart, np.int64).reshape(-1, 3).T
        weight = np.concatenate([np.ones(len(owner), np.int64), times])
        key, place = np.unique((np.concatenate([owner, own]) << 40) + np.concatenate([rare, number]), return_inverse=True)
        times = np.bincount(place, weight, len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        return total, key >> 40, key & ((1 << 40) - 1), times


def token_counts(
    docs: DataFrame, path: str, limit: int = 1024, head: int = 131_072, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) for every row of ``docs``."""
    spark = docs.sparkSession
    words = vocabulary(docs, path, text)
    top = words.where(F.length(F.encode("pre_token", "UTF-8")) <= HEAD_BYTES)
    top = top.orderBy(F.desc("frequency"), "pre_token").limit(head)
    known = spark.sparkContext.broadcast({r.pre_token: r.n_pieces for r in top.toLocalIterator()})

    def reduce_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(PreTokens(path), known.value)
        row = TaskContext.get().partitionId() << 40
        for batch, texts in steps(batches, 1):
            sizes = np.array(list(map(len, texts)), np.int64)
            total, owner, number, times = tally.batch([t.decode() for t in texts])
            # a text without rare pre-tokens gets a filler that has no pieces
            without = np.setdiff1d(np.arange(len(total)), owner)
            names = [tally.names[i] for i in number.tolist()] + [f"\x00{(row + i) % 65_536}" for i in without.tolist()]
            owner, times = np.concatenate([owner, without]), np.concatenate([times, np.zeros(len(without), np.int64)])
            # the document's own figures ride on its first row
            first = np.zeros(len(owner), bool)
            first[np.unique(owner, return_index=True)[1]] = True
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + owner),
                    pa.array(names, pa.string()),
                    pa.array(times.astype(np.int32)),
                    batch.column(0).take(pa.array(owner)),
                    pa.array(np.where(first, sizes[owner], 0)),
                    pa.array(np.where(first, total[owner], 0)),
                ],
                ["row", "pre_token", "n", "doc", "size", "total"],
            )
            row += len(total)
        tally.clear()
        give_back()

    frequencies = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        reduce_documents, "row long, pre_token string, n int, doc long, size long, total long"
    )
    joined = frequencies.join(words.select("pre_token", "n_pieces").hint("merge"), "pre_token", "left")
    tokens = F.sum(F.col("n") * F.coalesce("n_pieces", F.lit(0)) + F.col("total"))
    counted = joined.groupBy("row").agg(
        F.max("doc").alias(id), F.sum("size").cast("long").alias("n_bytes"), tokens.cast("long").alias("n_tokens")
    )
    return counted.select(id, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
