"""Quality rules that look at lines first and at the document afterwards.

Each line is judged by itself: its punctuation, whether it is navigation, and
whether it is boilerplate. Lines that fail are taken out, and a document that
loses too much of its text to them is rejected. Before that, counts over the
whole text (words, symbols, equal lines, words in repeated windows) reject what
is too short or mostly repetition.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"

#: A sentence's end: a mark, and what may close behind it.
ENDS = r"[.!?…。！？؟][\"'”’»)\]]*"
#: Items of a menu, a breadcrumb or a pager stand between these.
SEPARATORS = "|»›•·→"
#: A line of these alone is navigation.
MENU = (
    "home", "about", "about us", "contact", "contact us", "login", "log in", "logout", "log out", "sign in", "sign up", "register", "search", "menu", "sitemap", "site map",
    "next", "previous", "prev", "back", "back to top", "top", "read more", "more", "continue reading", "click here", "skip to content", "share", "tweet", "print", "help", "faq",
)
#: A line of up to `boilerplate_words` words with one of these is boilerplate.
PHRASES = (
    "all rights reserved", "copyright ©", "© copyright", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "use cookies", "uses cookies",
    "accept cookies", "enable javascript", "javascript is disabled", "subscribe to our newsletter", "sign up for our newsletter", "follow us on", "share this article", "powered by",
    "lorem ipsum", "page not found", "under construction",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules.

    A line passes the rule of punctuation if it ends with a mark or holds a
    sentence's end for each `words_per_sentence` words, if it doesn't hold more
    than one exclamation or question mark for each `words_per_shout` words
    (lines of five words or more), and if no more than `max_symbol_percent` of
    its characters are symbols.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_percent: int = 30
    words_per_sentence: int = 60
    words_per_shout: int = 2
    max_symbol_percent: int = 10
    words_per_separator: int = 4
    boilerplate_words: int = 60

    def patterns(self) -> dict[str, str]:
        """The expressions that the rules need, without any flags."""
        menu = "|".join(MENU)
        return {
            "end": ENDS + r"[\x20\x09-\x0D]*$",
            "ends": ENDS + r"(?:[\x20\x09-\x0D]|$)",
            "menu": rf"(?i)^[\x20\x09-\x0D]*(?:{menu})(?:[\x20\x09-\x0D]+(?:{menu}))*[\x20\x09-\x0D]*$",
            "phrase": f"(?i)(?:{'|'.join(PHRASES)})",
        }


class Cleaner:
    """The rules, compiled."""

    def __init__(self, rules: LineRules):
        self.rules = rules
        p = rules.patterns()
        self.end, self.ends, self.menu, self.phrase = (re.compile(p[k]) for k in ("end", "ends", "menu", "phrase"))

    def line(self, line: str, n_words: int) -> int:
        """0 for a line that passes; 1 navigation, 2 boilerplate, 3 punctuation: the first that fails."""
        r = self.rules
        found = sum(map(line.count, SEPARATORS))
        if (found >= 2 and found * r.words_per_separator >= n_words) or (len(line) < 200 and self.menu.search(line)):
            return 1
        if n_words <= r.boilerplate_words and self.phrase.search(line):
            return 2
        if n_words >= 5 and (line.count("!") + line.count("?")) * r.words_per_shout > n_words:
            return 3
        if 100 * sum(map(line.count, SYMBOLS)) > r.max_symbol_percent * len(line):
            return 3
        if not self.end.search(line) and len(self.ends.findall(line)) * r.words_per_sentence < n_words:
            return 3
        return 0

    def __call__(self, text: str | None) -> tuple:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, lines lost to each rule, and the text without them."""
        if text is None:
            return 0, 0, 0, 0, 0, True, False, 0, 0, 0, 0, None
        seen, ids, lines = {}, array("q"), set()
        chars = dup = lost = 0
        by_rule, left = [0, 0, 0, 0], []
        for line in text.split("\n"):
            words = WORD.findall(line)
            if not words:
                left.append(line)
                continue
            dup += line in lines
            lines.add(line)
            ids.extend([seen.setdefault(w, len(seen)) for w in words])
            size = sum(map(len, words))
            chars += size
            rule = self.line(line, len(words))
            by_rule[rule] += 1
            if rule:
                lost += size
            else:
                left.append(line)
        n, r = len(ids), self.rules
        repeat = repeated_windows(np.frombuffer(ids, np.int64), len(seen))
        failed = n < r.min_words or 100 * repeat > r.max_repeat_percent * n
        kept = not failed and 100 * lost <= r.max_lost_percent * chars
        return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, failed, kept, lost, *by_rule[1:], "\n".join(left)


def repeated_windows(ids: np.ndarray, n_words: int) -> int:
    """How many places of a sequence of numbers below n_words lie in a window of three that is found twice or more."""
    if len(ids) < 4:
        return 0
    _, pairs = np.unique(ids[:-1] * n_words + ids[1:], return_inverse=True)
    _, at, times = np.unique(pairs[:-1] * n_words + ids[2:], return_inverse=True, return_counts=True)
    again = times[at] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum())


RESULTS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(),
    "lost_chars": pa.int64(), "n_navigation": pa.int64(), "n_boilerplate": pa.int64(), "n_punctuation": pa.int64(), "cleaned": pa.string(),
}
_DDL = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}


def cleaned_lines(docs: DataFrame, text_column: str = "text", rules: LineRules = LineRules()) -> DataFrame:  # noqa: B008
    """docs with the counts of their texts, the lines lost to each rule, the cleaned text and whether the document is kept.

    Lines end at line feeds; one without a word is neither judged nor taken out.
    A line that fails several rules counts for the first of navigation,
    boilerplate and punctuation. lost_chars are the characters of words in lines
    that were taken out; a document that fails the counts over its whole text,
    or loses more than max_lost_percent of word_chars, is not kept. A null text
    has no words, isn't kept, and stays null; an empty one stays empty. Each row
    is judged by itself, so ties and repeated rows don't matter. All columns
    stay; those that bear the names of the results are replaced. No shuffle;
    memory grows with the longest text.
    """
    keep = [c for c in docs.columns if c not in RESULTS]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` {_DDL[t]}" for c, t in RESULTS.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cleaner = Cleaner(rules)
        for batch in batches:
            found = [cleaner(t.as_py()) for t in batch.column(len(keep))]
            columns = zip(*found) if found else [[] for _ in RESULTS]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, RESULTS.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*keep, *RESULTS])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_column}`").cast("string").alias("\x01text")).mapInArrow(run, ", ".join(fields))


def quality_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the characters and lines lost to the rules."""
    found = cleaned_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "n_navigation", "n_boilerplate", "n_punctuation")
