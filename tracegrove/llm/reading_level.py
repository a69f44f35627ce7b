"""Problem 8: the reading level of each document's English prose.

Each level has a smoothed unigram language model: a mixture of the unigram models of the bands into which
a readability formula (mean sentence length, mean word length) sorts the level's labelled texts. The end of
a sentence is a word of its own, so sentence length counts as the choice of words does. A word's
probability is interpolated between band, level, all texts and a class model (the band's share of the
word's class, spread over the class as in all texts), which keeps rarely seen words from deciding. Classes
are the sentence end, each connective, and the word lengths. A document gets the level with the highest posterior for all of its prose (equal priors).

The model is fitted on the labelled samples, at most ``SAMPLES`` of them, on the driver and is a few
thousand numbers. All documents are scored whole.

Prose is what remains without fenced and indented code, tables, headings, logs, lists of names and change
entries; hard-wrapped lines are joined, bullets are sentences. Text that is a source file has none.

A full sentence begins with a capital, ends with . ! ? or :, and has at least three words.

Defined cases: a document with fewer than ``LEAST`` full English sentences, null, empty or blank text has level
null and is not found. Equal posteriors: the lower level.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = 10_000  # labelled texts the model is fitted on, at most
LEAST = 5  # full sentences a document needs
WEIGHTS = (0.25, 0.10, 0.05, 0.60)  # band, level, all texts, share of the word's length (or of the connective, or of the sentence end)
STRAY = 0.1  # share of sentences that may be of another kind than the text
BANDS = ((15.0,), (4.6, 7.3))  # words a sentence; letters a word
END = "</s>"
# Words that join clauses.
CONNECTIVES = ["</s>", *"and but so if when while because whenever although before whereas provided insofar consequently notwithstanding then that".split()]

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_NAMES = re.compile(r"^[\s,;|-]*(?:`[^`]*`[\s,;|]*)+$")
_BULLET = re.compile(r"^(?:[-*+•]|\d{1,3}[.)])\s+")
_SKIP = re.compile(
    r"^(?:#{1,6}(?:\s|$)|\||>{3}|[-=*_~]{3,}$|\d{4}-\d\d-\d\d|\[?\d\d:\d\d|(?:\[\w+\]\s*)?(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE)\b|Traceback\b|at \w[\w.$]*\(|File \"|\$ |<[!/?a-zA-Z])"
    r"|[^.]{0,80}\([0-9a-f]{4,40}\)$"
)
_CODE = re.compile(
    r"[{};]$|^[})\]]|^(?:import|from|using|use|package|return|def|class|func|fn|pub|let|const|var|public|private|protected|internal|static|if|for|while|else|elsif|end|struct|type|impl|module|require_relative|export|function|async|#include|CREATE|INSERT|SELECT|FROM|WHERE|GROUP|@\w+)\b.*[({:;=\"'*]"
    r"|[\w\])]\s*(?:[-+*/:]?=|\+\+|--)\s*\S*|^\w+\([^)]*\)$|^\w+\([^)]*\)\s*\{$|^(?://|/\*|\*/|\*\s|\"\"\"|''')|^return\b|^end$|^#!|^import \w+$|^package \w+$"
)
_BREAK = re.compile(r"(?<=[.!?:])[\"')\]]*\s+")
_STOPS, _ENDS = frozenset(".!?"), frozenset(".!?:")
_COMMENT_STARTS = ("//", "/*", "*/", "* ", '"""', "'''")
_AROUND = ".,!?:;()[]{}\"'*_<>/\\|`~#=+-–—“”‘’…"
# Common words that tell English from other languages.
ENGLISH = frozenset("the a an this that these those every another any each one all some no of and or but so if when while because whenever although before after in on at to for with without by from under across during within is are was were be it its your our their he she they we you as not than then which who what into over".split())
FOREIGN = frozenset("der die das den dem des ein eine einen und oder nicht ist sind für mit ohne nach jede jeder jedem alle wird werden zu zur zum im vom bei le la les un une des du de et ou ne pas est sont pour avec sans sur dans chaque toute tous el los las una unos unas y o no es son para con sin sobre en cada toda todo todos del al por se que qui che il lo gli per non".split()) - {"a", "no", "o", "y", "an", "des", "die", "se"}


def prose(text: str | None) -> list[str]:
    """The full sentences of the text's prose, in any language."""
    if not text or not text.strip():
        return []
    text = _FENCE.sub("\n\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    lines = text.split("\n")
    full = [x for x in map(str.strip, lines) if x and not _SKIP.match(x) and not _NAMES.match(x)]
    if not full:
        return []
    is_code = {x for x in full if (x[-1] not in _STOPS and _CODE.search(x)) or x.startswith(_COMMENT_STARTS)}
    if sum(x in is_code for x in full) > 0.4 * len(full):  # a source file: its comments are no prose
        return []
    out: list[str] = []
    held: list[str] = []

    def flush():
        if not held:
            return
        for part in _BREAK.split(" ".join(held)):
            if part[-1:] in _ENDS and part.lstrip("\"'([*_ ")[:1].isupper():
                out.append(part)
        held.clear()

    for raw in lines:
        line = raw.strip()
        if not line or line in is_code or _SKIP.match(line):
            flush()
        elif line[0] in "`-*|," and _NAMES.match(line) or not held and raw.startswith(("    ", "\t")):
            flush()
        else:
            bullet = _BULLET.match(line)
            if bullet:
                flush()
                line = line[bullet.end() :]
            held.append(_INLINE.sub("", line) if "`" in line else line)
    flush()
    return out


def words_of(sentence: str) -> list[str]:
    """The words of a sentence, in lower case and without punctuation around them."""
    return [w for w in (x.strip(_AROUND) for x in sentence.lower().split()) if w and not w.isdigit()]


def _band(parts: list[list[str]]) -> tuple[int, int]:
    words = [w for p in parts for w in p]
    a, b = len(words) / max(1, len(parts)), sum(map(len, words)) / max(1, len(words))
    return sum(a >= x for x in BANDS[0]), sum(b >= x for x in BANDS[1])


def _kind(word: str) -> int:
    return CONNECTIVES.index(word) if word in CONNECTIVES else len(CONNECTIVES) + min(len(word), 24)


class _Ids(dict):
    """Row of a token as it stands in a sentence; at most ``most`` tokens are remembered."""

    most = 200_000

    def __init__(self, word: dict[str, int]):
        super().__init__()
        self.word = word

    def __missing__(self, token: str) -> int:
        w = token.strip(_AROUND)
        row = 0 if not w or w.isdigit() else self.word.get(w, min(len(w), 24))
        if len(self) < self.most:
            self[token] = row
        return row


class Levels:
    """Unigram models of all bands of all levels.

    ``log`` has a row for no word, for an unseen word of each length, for each known word, and for the sentence end.
    """

    def __init__(self, samples: list[tuple[int, str]]):
        bands: dict[tuple, Counter] = {}
        levels: dict[int, Counter] = {}
        overall: Counter = Counter()
        for level, text in samples:
            parts = [words_of(x) for x in prose(text)]
            counts = Counter(w for p in parts for w in p)
            counts[END] = len(parts)
            bands.setdefault((level, *_band(parts)), Counter()).update(counts)
            levels.setdefault(level, Counter()).update(counts)
            overall.update(counts)
        self.levels, self.bands = sorted(levels), sorted(bands)
        self.of = np.array([self.levels.index(b[0]) for b in self.bands])
        known = sorted(set(overall) | ENGLISH | FOREIGN)
        kind = np.array([_kind(w) for w in known])
        n_kinds = len(CONNECTIVES) + 25
        total = np.array([overall[w] for w in known], float)
        in_kind = np.bincount(kind, total, n_kinds) + 1  # one more for words never seen

        def share(counts: Counter) -> np.ndarray:
            return np.array([counts[w] for w in known], float) / max(1, sum(counts.values()))

        a, b, c, d = WEIGHTS
        rows = []
        for key in self.bands:
            by_kind = np.bincount(kind, [bands[key][w] for w in known], n_kinds) + 0.1
            by_kind /= by_kind.sum()
            unseen = d * by_kind[len(CONNECTIVES) :] / in_kind[len(CONNECTIVES) :] / 100
            seen = a * share(bands[key]) + b * share(levels[key[0]]) + c * share(overall) + d * by_kind[kind] * np.maximum(total, 0.01) / in_kind[kind]
            rows.append(np.concatenate([[1.0], unseen[1:], seen]))
        self.log = np.log(np.array(rows)).T.copy()
        self.word = {w: 25 + i for i, w in enumerate(known)}
        self.end = self.log[self.word[END]]
        self.english = np.zeros(len(self.log), np.int32)
        self.english[[self.word[w] for w in ENGLISH]] = 1
        self.english[[self.word[w] for w in FOREIGN]] -= 1
        self.prior = np.array([math.log(sum(bands[k].values()) / sum(levels[k[0]].values())) for k in self.bands])
        self.rows = _Ids(self.word)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Full English sentences of each text, and its level (0 if there is none)."""
        parts = [prose(t) for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        tokens = [x.lower().split() for p in parts for x in p]
        ids = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(tokens)), np.int64)
        sentence = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        words = np.bincount(sentence, ids > 0, len(tokens))
        english = np.bincount(sentence, self.english[ids], len(tokens))
        good = (words >= 3) & (english > 0)
        count = np.bincount(doc[good], minlength=len(texts))
        each = np.empty((len(tokens), len(self.bands)))
        for k in range(len(self.bands)):
            each[:, k] = np.bincount(sentence, self.log[ids, k], len(tokens))
        each = (each + self.end)[good]
        # A sentence may be borrowed from any band: none costs a band more than a chance of STRAY.
        any_band = np.logaddexp.reduce(each, axis=1, keepdims=True) - math.log(len(self.bands)) if len(each) else each
        each = np.logaddexp(each + math.log(1 - STRAY), any_band + math.log(STRAY))
        total = np.array([np.bincount(doc[good], each[:, k], len(texts)) for k in range(len(self.bands))]).T + self.prior
        best = np.full((len(texts), len(self.levels)), -np.inf)
        for k, level in enumerate(self.of):
            best[:, level] = np.logaddexp(best[:, level], total[:, k])
        return count, np.where(count >= LEAST, np.array(self.levels)[best.argmax(axis=1)], 0)


def fit(samples: DataFrame) -> Levels:
    """The models of the labelled texts (level, text), fitted on at most ``SAMPLES`` of them."""
    rows = samples.where("level is not null and text is not null").select("level", "text", "sample_id").orderBy("sample_id").limit(SAMPLES).collect()
    return Levels([(r.level, r.text) for r in rows])


def _scored(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels = model.value
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.iloc[a : a + 500]
                count, level = levels.score(part["text"].tolist())
                level = pd.array(level, "Int32")
                level[count < LEAST] = pd.NA
                yield part.drop(columns="text").assign(sentences=count.astype("int32"), level=level)

    return run


def reading_levels(documents: DataFrame, samples: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the number of full English sentences, and the level (null below ``LEAST`` sentences)."""
    model = documents.sparkSession.sparkContext.broadcast(fit(samples))
    rows = documents.select(*keep, F.col("text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInPandas(_scored(model), f"{shape}, sentences int, level int")


def level_profile(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """Documents per source and level."""
    scored = reading_levels(documents, samples, ("doc_id", "source"))
    return scored.groupBy("source", "level").agg(F.count("*").alias("documents"), F.sum(F.col("sentences").cast("long")).alias("sentences"))
