"""Toxicity of texts by a weighted lexicon: folded spellings, Aho-Corasick, exception phrases, length.

Texts are folded first: homoglyphs and accents to their base letter, digits and signs that stand for letters to
the letter. The lexicon is learned from labelled texts: whole words and beginnings of words, weighted by the
log odds of toxic texts. Hits within an exception phrase do not count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from attest.llm.common import text_batches, written

# Letters of other scripts, and digits and signs, that pass for a Latin letter (fixed values).
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
# Marks that are put between letters to hide a word.
DROPPED = "*_'’​‌‍⁠﻿­"

SIGNS = "!|$@"
STOPS = ".,;:?\"()[]{}"
# What is no letter at the start of a word: stops, and signs with no letter or digit after them.
_START = re.compile(r"^(?:[.,;:?\"()\[\]{}]|[!|$@]+(?![!|$@]*[^\W_]))+")
_LEADING = re.compile(r"(?<!\S)[.,;:?\"()\[\]{}!|$@]*[!|$@][^\W_]")

MOST_TOXIC = 4_000
MOST_CLEAN = 16_000
MOST_TERMS = 20_000
LEAST_TEXTS = 4
BEGINNINGS = range(3, 11)
SCORE = "toxicity_score"


class _Fold(dict):
    """A table for str.translate, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char in DROPPED:
            out = ""
        elif char in SUBSTITUTES:
            out = SUBSTITUTES[char]
        else:
            base = "".join(c for c in unicodedata.normalize("NFKD", char).lower() if not unicodedata.combining(c))
            out = "".join(HOMOGLYPHS.get(c, c if c.isalnum() else " ") for c in base)
        if len(self) < 100_000:
            self[code] = out
        return out


def folded_words(text: str, fold: _Fold, known=None) -> list[str]:
    """Words of a folded text. A sign at the end of a word ends a sentence, and is no letter.

    A sign before a letter or digit stands for a letter, save in prices. With `known`, the terms of a lexicon, it
    does so only where the word is known that way: `$tupid` is `stupid`, `@clown` a clown who is called.
    """
    out = []
    for word in text.split():
        word = word.rstrip(SIGNS + STOPS)
        if not word or word.isdigit():
            continue
        if word[0].isalnum():
            out += word.translate(fold).split()
            continue
        word = _START.sub("", word)
        bare = word.lstrip(SIGNS)
        if word.isdigit() or (bare.isdigit() and word[0] != "@"):
            continue
        words = word.translate(fold).split()
        if bare != word and known is not None and not any(t in known for t in terms(set(words))):
            words = [] if bare.isdigit() else bare.translate(fold).split()
        out += words
    return out


def terms(words: set[str]) -> set[str]:
    """What a lexicon can hold of these words: ` word ` and the beginnings ` wor`."""
    found = {f" {w} " for w in words if len(w) > 1}
    found.update(f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n)
    return found


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms, exception phrases, and the curve from hits to a score."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (weight, len(term)))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (0.0, len(phrase) + 2))
        found.make_automaton()
        return found


def measures(text: str, fold: _Fold, automaton) -> tuple[float, float]:
    """What the curve takes: the logarithm of the summed weights, and of the weights per hundred words.

    A word counts once, by its heaviest term; a word within an exception phrase does not count.
    """
    words = folded_words(text, fold, automaton)
    if not words or not len(automaton):
        return 0.0, 0.0
    line = f" {' '.join(words)} "
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (weight, size) in automaton.iter(line):
        start = end - size + 1
        if not weight:
            spared.append((start, end))
        elif weight > best.get(start, -math.inf):
            best[start] = weight
    for start, end in spared:
        for place in [p for p in best if start <= p < end]:
            del best[place]
    total = max(0.0, sum(best.values()))
    return math.log1p(total), math.log1p(100 * total / len(words))


def _logistic(rows: np.ndarray, labels: np.ndarray, steps: int = 30, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights of a logistic curve by Newton's method; the last is the constant."""
    x = np.column_stack((rows, np.ones(len(rows))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (labels - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _sampled(documents: DataFrame, labels: DataFrame, toxic: int, most: int) -> DataFrame:
    """At most `most` labelled texts, chosen by a hash of their id."""
    chosen = labels.filter(F.col("toxic") == toxic).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return documents.join(F.broadcast(chosen), "doc_id", "left_semi")


def _counts(name: str, wanted: frozenset[str] | None, phrased: bool):
    """Counts of texts for each term, and for phrases of a wanted term with the word before or after it."""

    def task(batches):
        fold, counts, phrases, texts_seen = _Fold(), Counter(), Counter(), 0
        for _, texts in text_batches(batches):
            for text in texts:
                words = folded_words(text, fold, wanted)
                texts_seen += 1
                found = terms(set(words))
                if _LEADING.search(text):  # with the sign as a letter, and without it
                    found |= terms({*folded_words(text, fold), *folded_words(text, fold, ())})
                counts.update(found if wanted is None else found & wanted)
                if phrased:
                    hits = [i for i, w in enumerate(words) if not terms({w}).isdisjoint(wanted)]
                    phrases.update({" ".join(words[i - 1 : i + 1]) for i in hits if i} | {" ".join(words[i : i + 2]) for i in hits})
        counts[""] = texts_seen
        kept = [(t, n, False) for t, n in counts.items()] + [(p, n, True) for p, n in phrases.items()]
        columns = list(zip(*kept))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], names=["term", name, "phrase"])

    return task


def learn(documents: DataFrame, labels: DataFrame, exceptions: frozenset[str] = frozenset(), most_toxic: int = MOST_TOXIC,
          most_clean: int = MOST_CLEAN, most_terms: int = MOST_TERMS, least_texts: int = LEAST_TEXTS) -> Lexicon:
    """Learns a lexicon from `labels` (doc_id, toxic) over a bounded sample: at most `most_toxic` and `most_clean` texts,
    chosen by a hash of doc_id. Counting is spread; at most `most_terms` terms reach the driver.

    A term counts for toxicity if it is in `least_texts` toxic texts and far likelier there. A phrase of a term and a
    neighbour that is likelier in clean texts becomes an exception, beside those given. Labels other than 0
    and 1, and labels without a text, are passed over; without toxic or clean texts the lexicon is empty.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("toxic in (0, 1) and doc_id is not null")
    toxic = written(_sampled(docs, marks, 1, most_toxic), "toxic-sample")
    clean = written(_sampled(docs, marks, 0, most_clean), "clean-sample")

    def summed(df: DataFrame, name: str, wanted: frozenset[str] | None = None, phrased: bool = False) -> DataFrame:
        counted = df.select("text").mapInArrow(_counts(name, wanted, phrased), f"term string, {name} long, phrase boolean")
        return counted.groupBy("term", "phrase").agg(F.sum(name).alias(name))

    frequent = summed(toxic, "n").filter((F.col("n") >= least_texts) | (F.col("term") == "")).orderBy(F.desc("n"), "term").limit(8 * most_terms)
    in_toxic = {r["term"]: r["n"] for r in frequent.collect()}
    wanted = frozenset(in_toxic)
    in_clean = {r["term"]: r["n"] for r in summed(clean, "n", wanted).filter("not phrase").collect()}
    n_toxic, n_clean = in_toxic.pop("", 0), in_clean.pop("", 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, frozenset(exceptions), (0.0, 0.0, -4.0))
    odds = {t: math.log((n + 0.5) / (n_toxic + 1)) - math.log((in_clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, n in in_toxic.items()}
    good = sorted((t for t, o in odds.items() if o > 2 and in_toxic[t] >= least_texts), key=lambda t: (-in_toxic[t], len(t), t))[:most_terms]
    weights: dict[str, float] = {}
    for t in sorted(good, key=lambda t: (len(t), t)):  # a beginning stands for the longer terms that begin with it
        if not any(t[:n] in weights and weights[t[:n]] >= 0.8 * odds[t] for n in range(4, len(t))):
            weights[t] = odds[t]
    spared = frozenset(exceptions)
    if held := frozenset(weights):
        tox = summed(toxic, "a", held, True).filter("phrase")
        cln = summed(clean, "b", held, True).filter("phrase")
        rows = cln.filter(F.col("b") >= least_texts).join(tox, ["term", "phrase"], "left").filter(
            F.col("b") / n_clean > F.coalesce("a", F.lit(0)) / n_toxic).orderBy(F.desc("b"), "term").limit(most_terms)
        spared |= {r["term"] for r in rows.collect()}
    lexicon = Lexicon(weights, spared)

    def measured(batches):
        fold, automaton = _Fold(), lexicon.automaton()
        for _, texts in text_batches(batches):
            columns = list(zip(*(measures(t, fold, automaton) for t in texts))) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], names=["total", "density"])

    seen = {label: np.array(df.select("text").mapInArrow(measured, "total double, density double").collect(), float).reshape(-1, 2) for label, df in ((1, toxic), (0, clean))}
    curve = _logistic(np.concatenate((seen[1], seen[0])), np.concatenate((np.ones(len(seen[1])), np.zeros(len(seen[0])))))
    return Lexicon(weights, spared, curve)


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Scores every whole text: all columns of `documents`, and SCORE (0 to 1), which replaces a column of that name.

    Only `text` is an input. Null and empty texts have no hits and get the score of such texts. The lexicon goes to
    the tasks with the function; its size is bounded by `most_terms`.
    """
    documents = documents.drop(SCORE)

    def task(batches):
        fold, automaton = _Fold(), lexicon.automaton()
        a, b, c = lexicon.curve
        for whole in batches:
            start = 0
            for batch, texts in text_batches([whole]):
                out = []
                for text in texts:
                    total, density = measures(text, fold, automaton)
                    out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a * total + b * density + c)))))
                # the columns as they came: null texts are empty in the slices only
                columns = whole.slice(start, batch.num_rows).columns
                start += batch.num_rows
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.float64())], names=[*whole.schema.names, SCORE])

    return documents.mapInArrow(task, StructType([*documents.schema.fields, StructField(SCORE, DoubleType())]))
