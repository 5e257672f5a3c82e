"""Exact token counts at every prefix, by dynamic programming over a BPE vocabulary.

Any prefix of a word has one encoding, and that encoding has one last token: of
the vocabulary tokens that end the prefix, the one that is compatible with the
last token of what lies before it. Two tokens are compatible if encoding their
joint text gives back just these two. So ``last[i]`` and ``count[i]`` follow
from earlier entries, one table answers how many tokens any prefix has, and a
truncation or budget question never encodes again.

This is for vocabularies with an end-of-word mark: the last token of a prefix
carries the mark, so for every prefix the table also tries the marked tokens.
A text is a sequence of words; prefix counts over words are running sums.

Plan: one scan with an Arrow function and no shuffle. Tables are kept per
worker for words seen before, up to a bound.

Defined cases: null counts as empty text (0 tokens); special strings in a text
count as one token each, as the library's default has it; texts and words of
any length are counted whole; repeated rows are counted each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textbytes import pretokens

MOST_WORDS, MOST_PAIRS, LONG_WORD, GROUP_CHARS = 1_000_000, 1_000_000, 200, 1 << 20


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Prefix tables for a byte-level BPE vocabulary with an end-of-word mark (a tokenizers .json file)."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.mark = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(p) if not isinstance(p, str) else tuple(p.split(" ")): i for i, p in enumerate(model["merges"])}
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        specials = [re.escape(x["content"]) for x in spec["added_tokens"]]
        self.specials = re.compile("|".join(sorted(specials, key=len, reverse=True))) if specials else None
        self.names = dict(enumerate(_byte_names()))
        self.split: dict[str, tuple[str, str]] = {}
        tokens = [x for x in model["vocab"] if self._kept(x)]
        self.final = {x[: -len(self.mark)] for x in tokens if x.endswith(self.mark)} if self.mark else set()
        self.inner = {x for x in tokens if not (self.mark and x.endswith(self.mark))}
        self.final = self.final or self.inner
        self.longest = max(map(len, self.inner | self.final))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}

    def _kept(self, token: str) -> bool:
        """Whether the token's own text encodes to it; notes the merge that makes it."""
        marked = bool(self.mark) and token.endswith(self.mark)
        parts = list(token[: -len(self.mark)] if marked else token)
        if not parts:
            return False
        if marked:
            parts[-1] += self.mark
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.ranks.get(p, len(self.ranks)))
            if best not in self.ranks:
                return False
            out: list[str] = []
            for x in parts:
                if out and (out[-1], x) == best:
                    out[-1] += x
                    continue
                out.append(x)
            self.split.setdefault("".join(best), best)
            parts = out
        return parts == [token]

    def compatible(self, a: str, b: str) -> bool:
        """Whether encoding the two tokens' joint text gives back just them.

        Undo the merges of both, latest first: at each step the outer parts
        that still touch must not have had a merge of their own before that step.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        left, right, ranks, split = a, b, self.ranks, self.split
        ahead = len(ranks) * 2  # twice the rank of the earliest merge undone so far, odd if on the right side
        known = True
        while True:
            joint = ranks.get((left, right))
            if joint is not None and 2 * joint < ahead:
                known = False
                break
            of_left, of_right = split.get(left), split.get(right)
            if of_left is None and of_right is None:
                break
            by_left = ranks[of_left] if of_left else -1
            by_right = ranks[of_right] if of_right else -1
            if by_left > by_right:
                left, ahead = of_left[1], 2 * by_left
            else:  # of equal merges the left one came first, so this one could still take the right part
                right, ahead = of_right[0], 2 * by_right + 1
        self.pairs[(a, b)] = known
        return known

    def _named(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.names)

    def _extend(self, w: str, last: list[str], count: list[int]) -> None:
        """Fill ``last`` and ``count`` for the prefixes of ``w`` that they don't cover yet."""
        inner, longest, compatible = self.inner, self.longest, self.compatible
        for i in range(len(last), len(w) + 1):
            for lo in range(i - longest if i > longest else 0, i):
                t = w[lo:i]
                if t in inner and (not lo or compatible(last[lo], t)):
                    last.append(t)
                    count.append(count[lo] + 1)
                    break

    def _end(self, w: str, i: int, last: list[str], count: list[int]) -> int:
        """Tokens of ``w[:i]`` as a word that ends there."""
        for lo in range(max(0, i - self.longest), i):
            t = w[lo:i]
            if t in self.final and (not lo or self.compatible(last[lo], t + self.mark)):
                return count[lo] + 1
        return 0

    def table(self, word: str) -> list[int]:
        """Token counts of the word's prefixes of 0, 1, ... characters, each as a word that ends there."""
        w, last, count = self._named(word), [""], [0]
        self._extend(w, last, count)
        at = accumulate((len(c.encode("utf-8", "surrogatepass")) for c in word), initial=0)
        return [self._end(w, i, last, count) for i in at]

    def learn(self, words: set[str]) -> dict[str, int]:
        """The counts of all words in ``words``; those seen before are looked up.

        New words are taken in order, so that each starts from the entries of
        the prefix that it shares with the one before.
        """
        if len(self.words) + len(words) > MOST_WORDS:
            self.words.clear()
        known = self.words
        last, count, before = [""], [0], ""
        for word in sorted(words.difference(known)):
            w = self._named(word)
            same = 0
            for x, y in zip(w, before, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            self._extend(w, last, count)
            known[word] = self._end(w, len(w), last, count)
            before = w
        return known

    def segments(self, text: str) -> tuple[list[str], int]:
        """The words of a text in order, and how many special tokens stand between them."""
        if self.specials is None or "<" not in text:
            return self._words(text), 0
        parts = self.specials.split(text)
        return [w for x in parts for w in self._words(x)], len(parts) - 1

    def _words(self, text: str) -> list[str]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return pretokens(text.replace("Σ", "σ").lower(), self.pattern)

    def count_all(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts, a group of about GROUP_CHARS at a time."""
        totals: list[int] = []
        group: list[tuple[list[str], int]] = []
        size = 0
        for text in [*texts, None]:
            if text is not None:
                group.append(self.segments(text))
                size += len(text)
            if group and (text is None or size >= GROUP_CHARS):
                known = self.learn({w for words, _ in group for w in words})
                totals += [special + sum(map(known.__getitem__, words)) for words, special in group]
                for words, _ in group:
                    for w in words if max(map(len, words), default=0) > LONG_WORD else ():
                        if len(w) > LONG_WORD:
                            known.pop(w, None)
                group, size = [], 0
        return totals

    def cut(self, text: str, limit: int) -> tuple[int, int]:
        """How much fits in ``limit`` tokens: whole words, then characters of the next. For texts without special tokens."""
        words, _ = self.segments(text)
        known = self.learn(set(words))
        running = list(accumulate((known[w] for w in words), initial=0))
        n = bisect_right(running, limit) - 1
        if n == len(words):
            return n, 0
        return n, max(i for i, c in enumerate(self.table(words[n])) if running[n] + c <= limit)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)




def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # imported by name, so that tables live as long as the worker and not as the task
        from millrace.llm import tokencount

        c = tokencount.counter(vocabulary)
        for s in texts:
            yield pd.Series(c.count_all(list(s)), dtype="int64")

    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), counted("text").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
