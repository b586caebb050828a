"""Subject areas of documents: weighted terms matched by a multi-pattern automaton.

The terms are curated from documents that readers have labelled: phrases of one
to three words that, in the part of a document that counts, are nearly always
accompanied by one subject, and, on a lower bar, the words of the note that says
what the subject covers.  At most ``sample_docs`` labelled documents (a
documented bound; taken by hash of their id) are brought to the driver for
this; everything else runs over all documents.

The part that counts is the claims or, where they are missing, the abstract
and description.  It is read in units (claims or sentences); a unit votes for subjects by the weights and rarity of
the terms in it, so neither length nor repetition inside a unit matters.  An
independent claim and the claims that refer to others after it form a group,
a whole text is one group.  A document gets every subject whose share of the
units of some group exceeds the threshold calibrated on the labelled documents,
scored by terms fitted without them.

Defined results: null and empty texts, and texts without any term, have no
subject; labels are compared trimmed and in small letters and count once per
document, labels not in ``subjects`` count nowhere; without labelled documents
there are no terms and no results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 8_000
#: A term needs this many labelled documents and this share of them with its subject; a word of the note on a subject needs fewer of both.
LEAST_DOCS, LEAST_SHARE = 4, 0.72
NOTE_DOCS, NOTE_SHARE = 2, 0.5

_CLAIMS = ("claims", "what is claimed is", "patentansprüche", "ansprüche", "revendications")
_OTHER = ("abstract", "zusammenfassung", "abrégé", "description", "detailed description", "background", "summary", "beschreibung")
_HEAD = re.compile(r"^[^\w\n]*(?:\(\d+\)\s*|\[\d+\]\s*)?(" + "|".join(_CLAIMS + _OTHER) + r")[\s:.]*$", re.I)
_NUMBERED = re.compile(r"^\s*(?:(?:c\Sa\Sm|anspruch|revendication)\s+)?\(?(\d{1,3})\s*[.):]\s+\S", re.I)
_REFERS = re.compile(r"\b(?:c\Sa\Sms?|anspruch|ansprüchen?|revendications?)\s+\d", re.I)
_LINES = re.compile(r"\r\n|\r|\n")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.;])\s+")
def units(text: str) -> tuple[list[list[str]], bool]:
    """The groups of units that count, and whether they are claims."""
    lines = _LINES.split(text)
    heads = [m.group(1).lower() if (m := _HEAD.match(l)) else "" for l in lines]
    under, own = False, []
    for line, head in zip(lines, heads):
        if head:
            under = head in _CLAIMS
        elif under and line.strip():
            own.append(line)
    if not any(_NUMBERED.match(l) for l in own):
        own = []
        start = next((k for k, l in enumerate(lines) if (m := _NUMBERED.match(l)) and m.group(1) == "1"), None)
        if start is not None:
            for line, head in zip(lines[start:], heads[start:]):
                if head:
                    break
                if line.strip():
                    own.append(line)
    if own:
        # a claim may run over several lines
        joined: list[str] = []
        for line in own:
            if joined and not _NUMBERED.match(line):
                joined[-1] += " " + line
            else:
                joined.append(line)
        groups: list[list[str]] = []
        for claim in joined:
            number = _NUMBERED.match(claim)
            if groups and _REFERS.search(claim, number.end() - 1 if number else 0):
                groups[-1].append(claim)
            else:
                groups.append([claim])
        return groups, True
    body = " ".join(l for l, h in zip(lines, heads) if not h)
    return [[s for s in _SENTENCE.split(body) if s]], False


def spaced(unit: str) -> str:
    return " " + " ".join(_WORD.findall(unit.casefold())) + " "


def _phrases(unit: str) -> set[str]:
    w = unit.split()
    return {" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)}


class Lexicon:
    """Terms with a subject and a weight, and the thresholds for claims and for whole texts."""

    def __init__(self, names: list[str], terms: dict[str, tuple[int, float]], thresholds: tuple[float, float] = (0.4, 0.3)) -> None:
        self.names, self.terms, self.thresholds = names, terms, thresholds
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"names": self.names, "terms": self.terms, "thresholds": self.thresholds, "_automaton": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term, value in self.terms.items():
                self._automaton.add_word(f" {term} ", value)
            self._automaton.make_automaton()
        return self._automaton

    def shares(self, groups: list[list[str]]) -> np.ndarray:
        """For each subject the largest share it has of the units with any term, over the groups."""
        best = np.zeros(len(self.names))
        if not self.terms:
            return best
        find = self.automaton().iter
        for group in groups:
            total = [0.0] * len(best)
            voting = 0
            for u in group:
                votes: dict[int, float] = {}
                for _, (subject, weight) in find(u):
                    votes[subject] = votes.get(subject, 0.0) + weight
                if votes:
                    voting += 1
                    s = sum(votes.values())
                    for subject, v in votes.items():
                        total[subject] += v / s
            if voting:
                np.maximum(best, np.array(total) / voting, out=best)
        return best

    def assign(self, groups: list[list[str]], claims: bool) -> list[tuple[int, float]]:
        share = self.shares(groups)
        limit = self.thresholds[0 if claims else 1]
        return [(int(k), float(share[k])) for k in np.flatnonzero(share >= limit) if share[k] > 0]


def note_words(notes: list[str | None]) -> dict[str, int]:
    """The words of the notes that stand in the note of one subject only, with that subject."""
    of: dict[str, set[int]] = {}
    for k, note in enumerate(notes):
        for w in spaced(note or "").split():
            of.setdefault(w, set()).add(k)
    return {w: s.pop() for w, s in of.items() if len(s) == 1}


def _curate(count: Counter, with_subject: Counter, docs: int, noted: dict[str, int]) -> dict[str, tuple[int, float]]:
    good: dict[str, tuple[int, float]] = {}
    for (phrase, s), n in with_subject.items():
        share = n / (count[phrase] + 0.5)
        least, bar = (NOTE_DOCS, NOTE_SHARE) if noted.get(phrase) == s else (LEAST_DOCS, LEAST_SHARE)
        if count[phrase] >= least and share > bar and (phrase not in good or share > good[phrase][1]):
            good[phrase] = (s, share)
    kept: dict[str, tuple[int, float]] = {}
    for phrase in sorted(good, key=lambda p: (p.count(" "), -count[p], p)):
        w = phrase.split()
        inner = [" ".join(w[a:b]) for a in range(len(w)) for b in range(a + 1, len(w) + 1) if b - a < len(w)]
        # a longer phrase says nothing new if a part of it is a term of the same subject
        if any(p in kept and kept[p][0] == good[phrase][0] for p in inner):
            continue
        s, share = good[phrase]
        kept[phrase] = (s, (2.0 * share - 1.0) * math.log1p(docs / count[phrase]))
    return kept


def fit(samples: list[tuple[int, list[list[str]], bool, set[int]]], names: list[str], notes: list[str | None] | None = None) -> Lexicon:
    """A lexicon from (fold, groups of spaced units, claims, subjects); thresholds by two-fold cross-fitting."""
    count: list[Counter] = [Counter(), Counter()]
    joint: list[Counter] = [Counter(), Counter()]
    docs = [0, 0]
    for fold, text, _, subjects in samples:
        docs[fold] += 1
        for p in set().union(*(_phrases(u) for group in text for u in group)):
            count[fold][p] += 1
            for s in subjects:
                joint[fold][(p, s)] += 1
    noted = note_words(notes or [])
    parts = [Lexicon(names, _curate(count[1 - f], joint[1 - f], docs[1 - f], noted)) for f in (0, 1)]
    thresholds = [0.4, 0.3]
    scored = [(claims, parts[fold].shares(text), subjects) for fold, text, claims, subjects in samples]
    for kind, default in ((True, 0.4), (False, 0.3)):
        own = [(s, t) for c, s, t in scored if c is kind and s.sum() > 0]
        if len(own) >= 50:
            grid = np.arange(0.02, 0.9, 0.01)
            truth = np.array([[k in t for k in range(len(names))] for _, t in own])
            share = np.array([s for s, _ in own])
            f1 = [2 * (hit := ((share >= g) & truth).sum()) / max(1, (share >= g).sum() + truth.sum()) for g in grid]
            best = np.flatnonzero(np.array(f1) >= max(f1) - 0.002)
            default = float(grid[best[len(best) // 2]])
        thresholds[0 if kind else 1] = default
    terms = _curate(count[0] + count[1], joint[0] + joint[1], sum(docs), noted)
    return Lexicon(names, terms, (thresholds[0], thresholds[1]))


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [units(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("subjects"), pa.array([[[spaced(u) for u in g] for g in gs] for gs, _ in out], pa.list_(pa.list_(pa.string()))), pa.array([c for _, c in out], pa.bool_())],
            names=["doc_id", "subjects", "units", "claims"],
        )


def clean_labels(labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject): one row per label, named as in ``subjects``."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    names = subjects.where(F.col("subject").isNotNull()).select(F.col("subject").alias("name"), key("subject").alias("key")).dropDuplicates(["key"])
    own = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), key("subject").alias("key"))
    return own.join(names, "key").select("doc_id", F.col("name").alias("subject")).distinct()


def _samples(docs: DataFrame, labels: DataFrame, subjects: DataFrame, sample_docs: int) -> tuple[list[str], list[str | None], list[tuple[int, list[list[str]], bool, set[int]]]]:
    """Subjects, their notes, and at most ``sample_docs`` labelled documents as ``fit`` takes them, with their ids as folds."""
    notes = {r["subject"]: r["note"] for r in subjects.where(F.col("subject").isNotNull()).groupBy("subject").agg(F.max("note").alias("note")).collect()}
    names = sorted(notes)
    index = {n: k for k, n in enumerate(names)}
    per_doc = clean_labels(labels, subjects).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    chosen = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "subjects", "text")
    rows = texts.mapInArrow(_regions, "doc_id bigint, subjects array<string>, units array<array<string>>, claims boolean").collect()
    # by id, so the fit does not depend on how the rows were read
    rows.sort(key=lambda r: r["doc_id"])
    return names, [notes[n] for n in names], [(r["doc_id"], r["units"], r["claims"], {index[s] for s in r["subjects"]}) for r in rows]


def _fold(doc: int) -> int:
    return (doc * 2654435761 >> 7) & 1


def learn(docs: DataFrame, labels: DataFrame, subjects: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Lexicon:
    names, notes, samples = _samples(docs, labels, subjects, sample_docs)
    return fit([(_fold(d), *rest) for d, *rest in samples], names, notes)


def held_out(docs: DataFrame, labels: DataFrame, subjects: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[tuple[bool, int, int, int, int]]:
    """(by claims, documents, areas given, areas of the labels, areas in both) on every third labelled document of the sample, by terms and thresholds of the others."""
    names, notes, samples = _samples(docs, labels, subjects, sample_docs)
    test = lambda d: (d * 2654435761 >> 9) % 3 == 0
    lexicon = fit([(_fold(d), *rest) for d, *rest in samples if not test(d)], names, notes)
    out = []
    for kind in (True, False):
        pairs = [({k for k, _ in lexicon.assign(units, claims)}, truth) for d, units, claims, truth in samples if test(d) and claims is kind]
        out.append((kind, len(pairs), sum(len(g) for g, _ in pairs), sum(len(t) for _, t in pairs), sum(len(g & t) for g, t in pairs)))
    return out


def _classifier(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        for b in batches:
            ids, names, shares, kinds = [], [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                groups, claims = units(text.as_py())
                for k, share in lexicon.assign([[spaced(u) for u in g] for g in groups], claims):
                    ids.append(doc)
                    names.append(lexicon.names[k])
                    shares.append(share)
                    kinds.append(claims)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(kinds, pa.bool_())], names=["doc_id", "subject", "share", "by_claims"])

    return run


def classify(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, subject, share, by_claims): the areas of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInArrow(_classifier(shared), "doc_id bigint, subject string, share double, by_claims boolean")


def composition(docs: DataFrame, areas: DataFrame) -> DataFrame:
    """(subject, documents, characters): a document with several areas counts in each, one with none under null."""
    sizes = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").alias("n"))
    return sizes.join(areas.select("doc_id", "subject"), "doc_id", "left").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").cast("bigint").alias("characters"))
