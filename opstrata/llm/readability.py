"""The reading level of English prose, by classic formulas over sentence lengths and rule-based syllable counts."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROSE = ("user_story", "plan", "guideline", "chat", "review", "tutorial", "postmortem")
LEVELS = 5
#: Least number of words, parted by white space, of a document that gets a level.
LEAST_WORDS = 60
#: Labelled rows, at most, that thresholds are fitted on; a sample by hash where there are more.
FIT_ROWS = 20_000

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: A sentence ends with its sign before white space, or with a line if the next one begins anew: with a capital, a number or a mark of a list.
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s|$)|\n\s*(?=[-*#•>]|\d+[.)]\s|[^\W\d_a-zß-öø-ÿ])")
# Rules of syllables. A word has as many as groups of vowels, less what is silent, more where vowels part.
_GROUPS = re.compile(r"[aeiouy]+")
_SILENT = re.compile(r"(?<=[^aeiouy])e$(?<!le)|(?<=[aeiouy])le(?=$)(?<=[aeiou]le)|(?<=[^aeiouytd])ed$|(?<=[^aeiouysxzc])(?<!ch)(?<!sh)(?<!g)es$|(?<=[^aeiouy])e(?=(?:ly|ment|less|ful|ness)$)")
_PARTED = re.compile(r"i[aou](?!u)(?<!tio)(?<!sio)(?<!cia)(?<!tia)(?<!gio)(?<!cio)(?<!xio)|[aeo]ing$|eo(?!u)|ua(?!r)|uou|[aeiouy]is[mt]$|ya|sm$|(?<=cr)ea(?=t(?!u))|(?<=[aeiou][^aeiouy])ea$")
# Frequent function words of languages in Latin script.
_FUNCTION = {
    "en": "the of and to is that it for was with as on be at by this had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many before must through back years where much your way well down should because each just those how too little state very make world still see own work long get here between both life being under never same another know while last might us great old year off come since against go came right used take three",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn können ihre dann unter wir soll ich hier alle einige ohne bevor danach müssen",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son leur aux être cette ont mais comme nous même sa ses aussi elle entre après avant deux fait était tout très sans peut si",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante antes después cada",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos cada antes",
    "it": "di e il la che in un a per è una sono con non del si da come le dei nel alla più anche ma al gli della i ha lo o questo tra su dopo prima ogni",
    "nl": "de het een en van in is op te dat die voor met zijn niet aan er om ook als bij maar door uit worden naar dan wordt nog over meer na elke voordat",
}
_LANGUAGES = {k: frozenset(v.split()) for k, v in _FUNCTION.items()}
#: English text has at least this share of English function words.
ENGLISH_SHARE = 0.1


def syllables(word: str) -> int:
    """Syllables of a word by rules, at least 1; parts of a hyphenated word count each."""
    total = 0
    for part in re.split(r"[\-'’]", word.lower()):
        if len(part) > 1 or not total:
            total += max(1, len(_GROUPS.findall(part)) - len(_SILENT.findall(part)) + len(_PARTED.findall(part)))
    return total


class _Words(dict):
    """The row of each word in ``table``: syllables, letters, and of which languages it is a function word. Worked out once a worker, forgotten when too many."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((1024, 2 + len(_LANGUAGES)), np.int64)

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = (syllables(word), sum(c.isalpha() for c in word), *(word in f for f in _LANGUAGES.values()))
        return k


_KNOWN = _Words()
#: Words that a worker remembers at most.
MOST_WORDS = 500_000


def clean(text: str) -> str:
    """The text in NFKC with line ends as newlines, without characters that have no width."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = re.sub(r"[­​-‏⁠﻿]", "", unicodedata.normalize("NFKC", text))
    return text


def facts(words: Counter) -> tuple[int, int, np.ndarray]:
    """(words, words of three syllables or more, sums over words of the columns of ``_Words.table``) of counted lower-case words."""
    if len(_KNOWN) > MOST_WORDS:
        _KNOWN.clear()
    at = np.fromiter(map(_KNOWN.__getitem__, words), np.int64, len(words))
    times = np.fromiter(words.values(), np.int64, len(words))
    rows = _KNOWN.table[at]
    return int(times.sum()), int(times[rows[:, 0] >= 3].sum()), times @ rows


def is_english(n: int, sums: np.ndarray) -> bool:
    """Whether n words with these sums are English: enough function words of it, and more than of any other language."""
    ours, *others = sums[2:]
    return n > 0 and ours >= ENGLISH_SHARE * n and all(o < ours for o in others)


def grade(text: str | None) -> float | None:
    """The school grade of a text: the median of five formulas; None if it isn't English or has no words."""
    if not text:
        return None
    text = clean(text)
    n, hard, sums = facts(Counter(_WORD.findall(text.lower())))
    if not is_english(n, sums):
        return None
    s = max(1, sum(1 for x in _SENTENCE.split(text) if _WORD.search(x)))
    per_sentence, per_word, letters = n / s, sums[0] / n, sums[1] / n
    # The published formulas of Flesch-Kincaid, SMOG, Gunning fog, the automated index and Coleman-Liau.
    grades = (
        0.39 * per_sentence + 11.8 * per_word - 15.59, 1.043 * (hard * 30 / s) ** 0.5 + 3.1291, 0.4 * (per_sentence + 100 * hard / n),
        4.71 * letters + 0.5 * per_sentence - 21.43, 5.88 * letters - 29.6 / per_sentence - 15.8,
    )
    return float(np.median(grades))


def _grades(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array([grade(t) for t in texts], pa.float64())], ["doc_id", "n_words", "grade"])


def grades(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, grade) of the prose documents with text; grade is null where the text isn't English."""
    d = documents.filter(F.col("kind").isin(*PROSE) & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return d.mapInArrow(_grades, "doc_id bigint, n_words bigint, grade double")


def fit_thresholds(pairs: list[tuple[float, int]]) -> list[float]:
    """The grades between levels with the least sum of absolute errors on (grade, level) pairs; of equal ones the middle of the widest gap.

    Without any pair: equal steps of five grades.
    """
    if not pairs:
        return [3.5 + 5 * k for k in range(LEVELS - 1)]
    z = np.array([p[0] for p in pairs])
    y = np.array([p[1] for p in pairs])
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gap = np.diff(edges)
    out = []
    for level in range(1, LEVELS):
        above = y > level
        errors = np.concatenate([[0], np.cumsum(above)]) + (~above).sum() - np.concatenate([[0], np.cumsum(~above)])
        errors = np.where(gap > 0, errors, len(y) + 1)
        best = np.flatnonzero(errors == errors.min())
        k = best[np.argmax(gap[best])]
        out.append(float((edges[k] + edges[k + 1]) / 2))
    return list(np.maximum.accumulate(out))


def labelled(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[tuple[float, int]]:
    """(grade, level) of at most ``fit_rows`` labelled rows: repeated rows once, null levels and texts without a grade left out."""
    rated = labels.filter(f"doc_id is not null and reading_level between 1 and {LEVELS}").select(F.col("doc_id").cast("bigint").alias("doc_id"), "reading_level", "rater").distinct()
    place = F.xxhash64("doc_id", "rater", "reading_level")
    n = rated.count()
    if n > fit_rows:  # thinned where it lies, so that what is sorted for the exact bound is small whatever the number of labels
        rated = rated.filter(F.pmod(place, F.lit(1_000_000)) < int(1_100_000 * fit_rows / n) + 1)
    chosen = rated.orderBy(place, "doc_id", "rater", "reading_level").limit(fit_rows)
    texts = documents.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    found = grades(texts).filter(f"grade is not null and n_words >= {LEAST_WORDS}").join(F.broadcast(chosen), "doc_id").select("grade", "reading_level")
    return [(r.grade, r.reading_level) for r in found.collect()]


def reading_levels(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, reading_level, grade): each English prose document of at least LEAST_WORDS words with its level.

    Null, empty, foreign and short texts and other kinds get no row; a repeated row is rated each time. What is fitted, on a bounded
    sample of labelled rows, are the four grades that part the levels; every document is graded whole, without a shuffle.
    """
    at = fit_thresholds(labelled(documents, labels, fit_rows))
    level = F.lit(1) + sum((F.col("grade") > t).cast("int") for t in at)
    return grades(documents).filter(f"grade is not null and n_words >= {LEAST_WORDS}").select("doc_id", level.cast("int").alias("reading_level"), "grade")
