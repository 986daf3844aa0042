"""Secret scans: patterns for labelled credentials, and probabilistic automata inferred from them that score all other candidates."""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyways.llm.common import table, trimmed, written

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # of a shorter run no later part can match either
HEX = re.compile(r"[0-9a-f]{32,}")
SHORTEST = 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
EDGE = "+/_.=-"
SAMPLE = 400
FOLDS = 4
ROUNDS = 3
ALPHA = 0.05
#: Levels of merging to choose from: the higher, the more states stay apart.
ALPHAS = (0.0001, 0.01, 0.05, 0.3, 0.7)
#: Half of the lengths' distribution is that of the words, the other half takes one in so many for any length.
LENGTHS = 64
RATIO = 0.2
MARGIN = 0.05
MISSED = 0.1
KNOWN = 200_000
PIECE = 64
#: Kinds of characters, each with how many characters it holds.
CLASSES = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20} | dict.fromkeys(EDGE, 1)
_KIND = {c: "0" for c in "0123456789"} | {c: "a" for c in "abcdef"} | {c: "g" for c in "ghijklmnopqrstuvwxyz"} | {c: "A" for c in "ABCDEF"} | {c: "G" for c in "GHIJKLMNOPQRSTUVWXYZ"} | {c: c for c in EDGE}
_TO = str.maketrans(_KIND)
_NONE = (0, -1)


def base(text: str) -> list[tuple[int, int, str]]:
    """(start, order of kind, end) of the spans that the patterns find, in order."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Runs of credential characters outside the spans that are SHORTEST characters or more."""
    starts, reach = [s for s, _, _ in spans], [*itertools.accumulate((e for _, _, e in spans), max)]
    for m in CANDIDATE.finditer(text):
        w, start, end = m.group(), m.start(), m.end()
        if w[0] in EDGE or w[-1] in EDGE:
            start, end = start + len(w) - len(w.lstrip(EDGE)), end - len(w) + len(w.rstrip(EDGE))
        before = bisect.bisect_left(starts, end)  # spans that begin before the run's end
        if end - start < SHORTEST or before and reach[before - 1] > start:
            continue
        yield start, end


def shape(word: str) -> int:
    """0 without digits, 1 without letters, 2 with both: each is sampled by itself, as words outnumber all others."""
    return 0 if word.isalpha() or not any(map(str.isdigit, word)) else 2 if any(map(str.isalpha, word)) else 1


class Automaton:
    """A probabilistic automaton by state merging (ALERGIA): the prefix tree of the words, folded where Hoeffding's bound can't tell two
    states' frequencies of next kinds of characters, and of next characters, apart. Steps go by kind; each state has its own
    frequencies of the characters of a kind, so a fixed prefix is learned letter by letter. Lengths have a distribution of their own:
    merged states would forget how deep a word is. Long words are learned in pieces of PIECE characters."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.lengths, self.words = Counter(map(len, words)), len(words)
        self.next: list[dict[str, list[int]]] = [{}]
        self.chars: list[dict[str, int]] = [{}]
        for piece in (w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)):
            at = 0
            for c, k in zip(piece, piece.translate(_TO), strict=True):
                self.chars[at][c] = self.chars[at].get(c, 0) + 1
                if k not in self.next[at]:
                    self.next[at][k] = [0, len(self.next)]
                    self.next.append({})
                    self.chars.append({})
                step = self.next[at][k]
                step[0] += 1
                at = step[1]
        self.out = [sum(x.values()) for x in self.chars]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            q = self.next[parent][c][1]
            if q in red:
                continue
            r = next((r for r in red if self._alike(r, q)), None)
            if r is None:
                red.append(q)
                blue += [(q, x) for x in sorted(self.next[q])]
            else:
                self.next[parent][c][1] = r
                self._fold(r, q)
                done = {*red}
                blue = [(p, x) for p in red for x in sorted(self.next[p]) if self.next[p][x][1] not in done]
        self._keep(red)

    def _alike(self, r: int, q: int) -> bool:
        pairs = [(r, q)]
        while pairs:
            r, q = pairs.pop()
            n, m = self.out[r], self.out[q]
            if not n or not m:
                continue
            most = self.bound * (n**-0.5 + m**-0.5)
            if most < 1:
                x, y = self.chars[r], self.chars[q]
                if any(abs(x.get(c, 0) / n - y.get(c, 0) / m) > most for c in x.keys() | y.keys()):
                    return False
                x, y = self.next[r], self.next[q]
                if any(abs(x.get(c, _NONE)[0] / n - y.get(c, _NONE)[0] / m) > most for c in x.keys() | y.keys()):
                    return False
            pairs += [(a, b) for c, (_, a) in self.next[r].items() if c in self.next[q] and (b := self.next[q][c][1]) != a]
        return True

    def _fold(self, r: int, q: int) -> None:
        pairs = [(r, q)]
        while pairs:
            r, q = pairs.pop()
            self.out[r] += self.out[q]
            for c, n in self.chars[q].items():
                self.chars[r][c] = self.chars[r].get(c, 0) + n
            for c, (count, to) in self.next[q].items():
                if c in self.next[r]:
                    self.next[r][c][0] += count
                    pairs.append((self.next[r][c][1], to))
                else:
                    self.next[r][c] = [count, to]

    def _keep(self, red: list[int]) -> None:
        number = {s: i for i, s in enumerate(red)}
        self.states = len(red)
        self.step: list[dict[str, tuple[float, int]]] = []
        for s in red:
            total = self.out[s] + 0.5 * len(CLASSES)
            row = {}
            for c, k in _KIND.items():
                n, to = self.next[s].get(k, _NONE)
                row[c] = math.log((n + 0.5) / total * (self.chars[s].get(c, 0) + 1) / (n + CLASSES[k])), number.get(to, 0)
            self.step.append(row)
        del self.next, self.chars, self.out

    def score(self, word: str) -> float:
        """The log-likelihood of the word; an unseen step leads back to the first state."""
        at, total, step = 0, 0.0, self.step
        for c in word:
            p, at = step[at][c]
            total += p
        return total + math.log((self.lengths[len(word)] / max(self.words, 1) + 1 / LENGTHS) / 2)


def fitting(words: list[str]) -> float:
    """The level of merging, of ALPHAS, under which automata of the other folds give one fold's words the highest likelihood."""
    fold = lambda w: zlib.crc32(w.encode()) % FOLDS == 0
    out, rest = [w for w in words if fold(w)], [w for w in words if not fold(w)]
    if not out or not rest:
        return ALPHA
    score = {a: sum(map(Automaton(rest, a).score, out)) for a in ALPHAS}
    return max(ALPHAS, key=lambda a: (round(score[a], 6), -a))


class Grammar:
    """An automaton of each kind's credentials, one of other candidates; a word's score for a kind is their log-likelihood ratio per
    character, and it is found if some kind's threshold is reached.

    No word's own part in an automaton raises or lowers its score when thresholds are set: words are scored by automata of the other
    folds. Others that score half as high as nine in ten held-out credentials of some kind do are taken for unlabelled credentials and
    leave the negatives. A kind's threshold lies MARGIN above what remains, but not above those credentials' scores, and never below
    the likelihood ratio RATIO.
    """

    least = 0.0

    def __init__(self, credentials: list[str] | dict[str, list[str]], others: list[str]):
        kinds = credentials if isinstance(credentials, dict) else {KINDS[0]: credentials}
        kinds = {k: sorted({*words}) for k, words in kinds.items() if words}
        level = {k: fitting(words) for k, words in kinds.items()}
        self.kinds = {k: Automaton(words, level[k]) for k, words in kinds.items()}
        self.good = self.kinds if isinstance(credentials, dict) else self.kinds.get(KINDS[0])  # a plain list has one automaton
        own = {k: self._apart(words, lambda w, a=level[k]: Automaton(w, a)) for k, words in kinds.items()}
        left, bad_level = [*others], fitting(others)
        for _ in range(ROUNDS):
            self.bad = Automaton(left, bad_level)
            against = self._apart(left, lambda w: Automaton(w, bad_level))
            good = {k: sorted((own[k][w] - self.bad.score(w)) / len(w) for w in words) for k, words in kinds.items()}
            bad = {k: [(self.kinds[k].score(w) - against[w]) / len(w) for w in left] for k in kinds}
            reached = {k: x[int(MISSED * len(x))] for k, x in good.items()}
            alike = {k: max(RATIO, x / 2) for k, x in reached.items()}
            rest = [w for i, w in enumerate(left) if all(bad[k][i] < alike[k] for k in kinds)]
            if len(rest) == len(left):
                break
            left = rest
        self.thresholds = {k: max(RATIO, min(reached[k], max((x + MARGIN for x in bad[k] if x < alike[k]), default=RATIO))) for k in kinds}
        self.bad, self.known = Automaton(left, bad_level), {}

    @staticmethod
    def _apart(words: list[str], fit) -> dict[str, float]:
        """Each word's log-likelihood by an automaton of the other folds."""
        out = {}
        for k in range(FOLDS):
            inside = [w for w in words if zlib.crc32(w.encode()) % FOLDS == k]
            if inside:
                a = fit([w for w in words if zlib.crc32(w.encode()) % FOLDS != k])
                out |= {w: a.score(w) for w in inside}
        return out

    def score(self, word: str) -> float:
        """The highest score of a kind, less that kind's threshold."""
        bad = self.bad.score(word)
        return max((a.score(word) - bad) / len(word) - self.thresholds[k] for k, a in self.kinds.items())

    def finds(self, word: str) -> bool:
        """Whether a threshold is reached; the answers for KNOWN words are kept."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            found = self.known[word] = self.score(word) >= self.least
        return found


def scan(text: str, grammar: Grammar | None) -> list[tuple[int, int, int]]:
    """(start, order of kind, end) of all spans of a whole text, in order."""
    found = base(text)
    if grammar:
        found = sorted(found + [(s, 3, e) for s, e in candidates(text, found) if grammar.finds(text[s:e])])
    return found


def labelled(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, list[str]], list[str]]:
    """At most `sample` distinct credentials of each kind and as many other candidates of each shape, those of the least hashes in all
    documents."""

    def find(batches):
        for batch in batches:
            found = set()
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                spans = base(text)
                for s, k, e in spans:
                    m = ASSIGN.fullmatch(text, s, e) if k == 0 else None
                    found.add((k - 3, m.group(2) if m else text[s:e]))
                found |= {(shape(w), w) for w in {text[s:e] for s, e in candidates(text, spans)}}
            order = [(k, zlib.crc32(w.encode()), w) for k, w in found]
            rows = [x for kind in range(-3, 3) for x in heapq.nsmallest(sample, (x for x in order if x[0] == kind))]  # no others can be among the least
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["kind", "hash", "word"])

    found = written(docs.select("text").mapInArrow(trimmed(find), "kind int, hash long, word string").distinct(), "candidates")
    pick = lambda kind: [r["word"] for r in found.filter(F.col("kind") == kind).orderBy("hash", "word").limit(sample).collect()]
    good = {KINDS[kind + 3]: pick(kind) for kind in range(-3, 0)}
    known = {w for words in good.values() for w in words}
    return good, [w for kind in range(3) for w in pick(kind) if w not in known]


def learn(docs: DataFrame, sample: int = SAMPLE) -> Grammar | None:
    """None where no credential is labelled or no other candidate is there: then only the patterns count."""
    good, bad = labelled(docs, sample)
    return Grammar(good, bad) if any(good.values()) and bad else None


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, grammar: Grammar | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_grammar of every row. Null text is empty; repeated rows give
    repeated rows; offsets are code points; other columns play no part. Texts are scanned whole, however long; an empty table gives none."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def look(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = scan(text or "", grammar)
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                rows.append((*n[:3], hashlib.sha256(digest([x for x in spans if x[1] < 3]).encode()).hexdigest(), digest(spans), n[3]))
            columns = [[r[i] for r in rows] for i in range(6)]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(look), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long")


def covered(text: str, grammar: Grammar | None, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    end = -1
    for s, _, e in scan(text, grammar):
        if s < end:
            end = max(end, e)
            continue
        if end >= 0:
            at = end
        out += [text[at:s], mark]
        end = e
    return "".join(out) + text[max(end, 0) :] if out else text


def redact(docs: DataFrame, grammar: Grammar | None) -> DataFrame:
    """docs with all secrets in text replaced; n_chars, if there, follows. Null texts stay null."""

    def clean(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else covered(t, grammar) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(trimmed(clean), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, learn(docs))
