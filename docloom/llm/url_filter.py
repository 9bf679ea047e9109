"""URL filters: host word segmentation by unigram Viterbi, then multinomial naive Bayes.

1. Words are counted where their bounds are known: runs of letters in paths,
   in host labels of several runs, and top-level domains, each once for a host
   (a host's own runs in its path are no evidence).  Host labels of a single
   run are then split by those words, and their pieces are counted too, so a
   concatenation can't vouch for itself, however many pages it has.  Of these
   words the model holds those that stand in some host, found by lookup.
2. Host labels are split into the most probable sequence of words (Viterbi).
3. Naive Bayes counts segmented host words and path words of all urls in
   hashed buckets for two classes.  No url comes with a label, so the classes
   are found by a seed list: a url whose segmented host holds a seed word is of
   class block.  The model then also knows the words that keep such company.
4. A url that a rule fits gets that rule's verdict, any other the model's.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged by the prior alone; repeated rows are judged each;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize

BUCKETS = 1 << 16
# Words of hosts that a training corpus leaves out.
SEEDS = frozenset(
    "adult betting casino cheap cialis clickbait crack escort jackpot keygen loan lottery malware payday pharmacy "
    "phishing pills poker porn replica sex slots spam torrent viagra warez xxx".split()
)
#: (verdict, host, start of the path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_LOWER = {c: c + 32 for c in range(65, 91)}
_HOST_END, _PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")
_RUNS = re.compile(r"[^\W\d_]+")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = _HOST_END.search(rest)
    end = cut.start() if cut else len(rest)
    tail = rest[end:]
    stop = _PATH_END.search(tail)
    return rest[:end].translate(_LOWER), tail[: stop.start()] if stop else tail


def rule_for(host: str, path: str, rules: tuple = RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; of equally long ones the first in order of their text."""
    fits = [
        (-len(h + p), h + p, verdict) for verdict, h, p in rules
        if path.startswith(p) and (host == h or host.endswith("." + h))
    ]
    return min(fits)[1:] if fits else None


def segment(run: str, cost: dict[str, float], unknown: float, sizes: Sequence[int] | None = None) -> list[str]:
    """The most probable words of a letter run; an unknown word costs more with each letter.

    sizes: the lengths of the known words, largest first.
    """
    if sizes is None:
        sizes = lengths(cost)
    best, back = [0.0] * (len(run) + 1), [0] * (len(run) + 1)
    low, origin = 0.0, 0  # the best start of an unknown word, of all so far
    for end in range(1, len(run) + 1):
        best[end], back[end] = low + unknown + 2.5 * end, origin
        for n in sizes:
            if n <= end:
                c = cost.get(run[end - n : end])
                if c is not None and best[end - n] + c < best[end]:
                    best[end], back[end] = best[end - n] + c, end - n
        if best[end] - 2.5 * end < low:
            low, origin = best[end] - 2.5 * end, end
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def lengths(words: Iterable[str]) -> tuple[int, ...]:
    return tuple(sorted(set(map(len, words)), reverse=True))


@dataclass(frozen=True)
class Segmenter:
    cost: dict[str, float]
    unknown: float

    @cached_property
    def sizes(self) -> tuple[int, ...]:
        return lengths(self.cost)

    def tokens(self, host: str, path: str) -> tuple[list[str], list[str]]:
        """Host words and path words."""
        words = [w for run in _RUNS.findall(host) for w in segment(run, self.cost, self.unknown, self.sizes)]
        return words, [w.translate(_LOWER) for w in _RUNS.findall(path)]


def _inside(words: DataFrame, runs: DataFrame, whole: bool) -> DataFrame:
    """Those of ``words`` that stand in some run (as all of it: only with ``whole``)."""
    sizes = [r.n for r in words.select(F.length("word").alias("n")).distinct().collect()]  # lengths, not words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run in b.column("word").to_pylist():
                found = {run[i : i + n] for n in sizes if n < len(run) + whole for i in range(len(run) - n + 1)}
                yield pa.record_batch({"word": pa.array(list(found), pa.string())})

    return words.join(runs.mapInArrow(cut, "word string").distinct(), "word", "left_semi")


def fit_words(pages: DataFrame) -> Segmenter:
    """Unigram costs from words with known bounds, and from the pieces into which they split the other runs of hosts."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(host, word, kind): 0 with known bounds, 1 the single run of a label."""
        for b in batches:
            found: set[tuple[str, str, int]] = set()
            for u in b.column("url").to_pylist():
                host, path = parts(u)
                labels = [_RUNS.findall(x) for x in host.split(".")]
                for k, runs in enumerate(labels, 1):
                    found.update((host, w, int(len(runs) == 1 and k < len(labels))) for w in runs)
                own = {w for runs in labels for w in runs}
                found.update((host, w, 0) for w in _RUNS.findall(path.translate(_LOWER)) if w not in own)
            cols = list(zip(*found, strict=True)) if found else [(), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32()), strict=True)], ["host", "word", "kind"])

    seen = pages.select("url").mapInArrow(bounded, "host string, word string, kind int").distinct()
    counts = materialize(seen.groupBy("word", "kind").agg(F.count("*").alias("n")), "words")
    known, runs = counts.where("kind = 0").select("word", "n"), counts.where("kind = 1").select("word", "n")
    first = _segmenter(known, _inside(known, counts.select("word").distinct(), True))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[str] = Counter()
            for run, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                for w in segment(run, first.cost, first.unknown, first.sizes):
                    found[w] += n
            yield pa.record_batch({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    split = runs.mapInArrow(pieces, "word string, n long")
    every = materialize(known.unionByName(split).groupBy("word").agg(F.sum("n").alias("n")), "words")
    sure, hosts = every.join(known, "word", "left_semi"), counts.select("word").distinct()
    new = every.join(known, "word", "left_anti")
    # a run that stands in no other one is its own unknown word in any case
    return _segmenter(every, _inside(sure, hosts, True).unionByName(_inside(new, hosts, False)))


def _segmenter(words: DataFrame, held: DataFrame) -> Segmenter:
    total = words.agg(F.sum("n")).first()[0] or 1
    seeds = {w: log(total + 1) for w in SEEDS}  # a seed word is known, seen or not
    return Segmenter(seeds | {r.word: log(total / r.n) for r in held.collect()}, log(total) + 2)


def _bucket(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind} {word}".encode()) % BUCKETS


@dataclass(frozen=True)
class UrlModel:
    segmenter: Segmenter
    #: log ratio of block to allow, by bucket, and of the classes themselves
    weights: np.ndarray
    prior: float

    def chance(self, host: str, path: str) -> float:
        """The posterior of class block."""
        hosts, paths = self.segmenter.tokens(host, path)
        s = self.prior + sum(self.weights[_bucket("h", w)] for w in hosts) + sum(self.weights[_bucket("p", w)] for w in paths)
        return 1 / (1 + exp(-max(-60.0, min(60.0, float(s)))))


def fit(pages: DataFrame) -> UrlModel:
    """Segmenter, then class counts over all urls."""
    seg = fit_words(pages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, urls = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for u in b.column("url").to_pylist():
                hosts, paths = seg.tokens(*parts(u))
                y = int(not SEEDS.isdisjoint(hosts))
                urls[y] += 1
                for w in hosts:
                    tally[y, _bucket("h", w)] += 1
                for w in paths:
                    tally[y, _bucket("p", w)] += 1
        y, k = np.nonzero(tally)
        yield pa.record_batch(
            {
                "y": pa.array(np.concatenate((y, [0, 1])).astype(np.int32)),
                "bucket": pa.array(np.concatenate((k, [-1, -1])).astype(np.int32)),
                "n": pa.array(np.concatenate((tally[y, k], urls))),
            }
        )

    got = pages.select("url").mapInArrow(count, "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n"))
    tally, urls = np.zeros((2, BUCKETS)), np.zeros(2)
    for r in got.collect():  # at most 2 * BUCKETS + 2 rows
        if r.bucket < 0:
            urls[r.y] = r.n
        else:
            tally[r.y, r.bucket] = r.n
    used = max(1, int((tally.sum(0) > 0).sum()))
    likely = np.log((tally + 0.5) / (tally.sum(1, keepdims=True) + 0.5 * used))
    return UrlModel(seg, likely[1] - likely[0], log((urls[1] + 0.5) / (urls[0] + 0.5)))


def judge(pages: DataFrame, model: UrlModel, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words (of the host, blank-joined) and chance (of block) of every row."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("host", "path", "rule", "verdict", "words", "chance")}
            for u in b.column("url").to_pylist():
                host, path = parts(u)
                rule, chance = rule_for(host, path, rules), model.chance(host, path)
                verdict = rule[1] if rule else "block" if chance > 0.5 else "allow"
                words = " ".join(model.segmenter.tokens(host, "")[0])
                for c, v in zip(out, (host, path, rule and rule[0], verdict, words, chance), strict=True):
                    out[c].append(v)
            yield pa.record_batch(
                {"page_id": b.column("page_id")}
                | {c: pa.array(v, pa.float64() if c == "chance" else pa.string()) for c, v in out.items()}
            )

    return pages.select("page_id", "url").mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string, words string, chance double"
    )


def url_verdicts(pages: DataFrame) -> DataFrame:
    """Fit on all urls, then judge each."""
    return judge(pages, fit(pages))
