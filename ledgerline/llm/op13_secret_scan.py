"""Secret scans: fixed rules, and formats of credentials learned by grammar inference.

Rules find the base spans of three kinds. The credentials that they label are then what formats are learned from: the
values of a kind make a prefix tree with counts, and states whose outgoing frequencies agree within Hoeffding's bound are merged, from the
root outward, into a probabilistic automaton. Tokens that no rule labels make one more automaton, of plain tokens; those that a kind's automaton accepts
are left out of it, unless the kind accepts so many (more than FOREIGN of them) that its format says little. Every token that no rule labels
in a text and that is long enough is a candidate; it is scored by each kind's automaton against the plain one. A kind that knows the token's
symbols, and was learned from such lengths, accepts it; of these, the one of the largest likelihood ratio adds a span if
the ratio reaches LEAST_BITS, and LEAST_RATE bits a character.

Every text is read whole, once: base spans and candidates are narrow rows, staged, from which the automata are fit and on which they are scored. Only
the fit takes a sample: at most LEARNED different values of each kind and of plain tokens, those of the smallest hashes, none
longer than LEARNED_CHARS; its size bounds what reaches the driver and what goes to the executors.

Cases: a null or empty text has no spans. Repeated rows and null identifiers are returned as they came; equal texts get equal spans. An
empty table gives an empty result; other columns are ignored, whatever their names. A kind without labelled credentials adds no spans. A text needs
its own size in memory several times over (about 8 bytes a character), however long it is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import staged, table

# The rules, in the order of their kinds, and the fewest characters of what they find.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = re.compile("pass|secret|token|api", re.IGNORECASE)
# Maximal runs from their first character on: the fewest characters can stand in these two patterns.
_ACCESS, _HEX = re.compile("AKIA[A-Z0-9]{12,}"), re.compile("[0-9a-f]{32,}")
ASSIGN_CHARS = 8
#: Tokens that are scored: runs of the characters of credentials, but for full stops, of at least so many.
_CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{16,}")
SYMBOLS = 66
#: Values that each automaton is learned from, and characters of one; significance of the merging test; bits that add a span, and bits a character.
LEARNED, LEARNED_CHARS, ALPHA, LEAST_BITS, LEAST_RATE = 3000, 256, 0.05, 16.0, 0.4
#: Share of plain tokens up to which those of a kind's format are taken for credentials that no rule labels.
FOREIGN = 0.1


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of what the rules find, by start and then by kind as listed; places count code points."""
    found = []
    if _WORDS.search(text):
        found += [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_CHARS]
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        found += [(m.start(), kind, m.end(), m[0]) for m in pattern.finditer(text)]
    return [(start, KINDS[kind], end, value) for start, kind, end, value in sorted(found)]


def candidates(text: str, base: list[tuple[int, str, int, str]]) -> list[tuple[int, str]]:
    """(start, token) of the tokens that overlap no base span."""
    out, k = [], 0
    ends, reach = [], 0
    for start, _, end, _ in base:  # spans may overlap each other: their union, in order
        if ends and start <= reach:
            ends[-1] = (ends[-1][0], max(reach, end))
        else:
            ends.append((start, end))
        reach = ends[-1][1]
    for m in _CANDIDATE.finditer(text):
        while k < len(ends) and ends[k][1] <= m.start():
            k += 1
        if k == len(ends) or ends[k][0] >= m.end():
            out.append((m.start(), m[0]))
    return out


_SPANS = "array<struct<kind: string, start: int, end: int, value: string>>"
_TOKENS = "array<struct<start: int, value: string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, tokens): base spans with their values, and candidates, of every row."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([read.schema["id"], *T._parse_datatype_string(f"spans {_SPANS}, tokens {_TOKENS}").fields])
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
    token = pa.struct([("start", pa.int32()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, tokens = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans.append([{"kind": kind, "start": start, "end": end, "value": value} for start, kind, end, value in base])
                tokens.append([{"start": start, "value": value} for start, value in candidates(text or "", base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span)), pa.array(tokens, pa.list_(token))], names=schema.names)

    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)


# --- grammar inference ------------------------------------------------------------------------------------------------


class Automaton:
    """A probabilistic automaton: how often each state was reached, ended in, and left by each symbol."""

    def __init__(self):
        self.reached, self.ended = [0], [0]
        self.step: list[dict[str, int]] = [{}]
        self.used: list[dict[str, int]] = [{}]  # how often a step was taken
        self.shortest, self.longest = math.inf, 0
        self.anywhere: dict[str, int] = {}  # where a symbol led most often

    def add(self, value: str) -> None:
        """Puts a value into the prefix tree."""
        at = 0
        self.shortest, self.longest = min(self.shortest, len(value)), max(self.longest, len(value))
        self.reached[0] += 1
        for symbol in value:
            self.used[at][symbol] = self.used[at].get(symbol, 0) + 1
            after = self.step[at].get(symbol)
            if after is None:
                after = self.step[at][symbol] = len(self.step)
                self.reached.append(0)
                self.ended.append(0)
                self.step.append({})
                self.used.append({})
            at = after
            self.reached[at] += 1
        self.ended[at] += 1

    def _agree(self, a: int, b: int, width: float) -> bool:
        """Whether two states end and leave by each symbol alike, within Hoeffding's bound."""
        n, m = self.reached[a], self.reached[b]
        bound = width * (n**-0.5 + m**-0.5)
        if abs(self.ended[a] / n - self.ended[b] / m) >= bound:
            return False
        p, q = self.used[a], self.used[b]
        return all(abs(p.get(s, 0) / n - q.get(s, 0) / m) < bound for s in p.keys() | q.keys())

    def compatible(self, a: int, b: int, width: float) -> bool:
        """Whether the tree below b agrees with what follows a, state by state."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if not self._agree(a, b, width):
                return False
            todo += [(self.step[a][s], after) for s, after in self.step[b].items() if s in self.step[a]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to what follows a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.reached[a] += self.reached[b]
            self.ended[a] += self.ended[b]
            for symbol, after in self.step[b].items():
                self.used[a][symbol] = self.used[a].get(symbol, 0) + self.used[b][symbol]
                own = self.step[a].setdefault(symbol, after)
                if own != after:
                    todo.append((own, after))

    def merge(self, alpha: float = ALPHA) -> Automaton:
        """Merges compatible states. Settled states grow from the root; each state that one of them leads to joins the one, of those that it agrees with, that expects its steps most, or settles."""
        width = math.sqrt(0.5 * math.log(2 / alpha))
        settled, known, open_at = [0], {0}, 0
        while open_at < len(settled):
            a = settled[open_at]
            for symbol in sorted(self.step[a], key=lambda s: (-self.used[a][s], s)):
                b = self.step[a][symbol]
                if b in known:
                    continue
                into = min((r for r in settled if self.compatible(r, b, width)), key=lambda r: self._surprise(r, b), default=None)
                if into is None:
                    settled.append(b)
                    known.add(b)
                else:
                    self.step[a][symbol] = into
                    self.fold(into, b)
            # Folding may have given settled states before this one new steps.
            open_at = next((k for k in range(open_at + 1) if any(b not in known for b in self.step[settled[k]].values())), open_at + 1)
        return self._only(settled)

    def _only(self, states: list[int]) -> Automaton:
        out, number = Automaton(), {s: k for k, s in enumerate(states)}
        out.reached, out.ended = [self.reached[s] for s in states], [self.ended[s] for s in states]
        out.step = [{c: number[t] for c, t in self.step[s].items()} for s in states]
        out.used = [self.used[s] for s in states]
        out.shortest, out.longest = self.shortest, self.longest
        most: dict[str, tuple[int, int]] = {}
        for steps, used in zip(out.step, out.used):
            for symbol, after in steps.items():
                most[symbol] = max(most.get(symbol, (0, 0)), (used[symbol], after))
        out.anywhere = {symbol: after for symbol, (_, after) in most.items()}
        return out

    def accepts(self, value: str) -> bool:
        """Whether a value is of a length that was learned from, and each of its symbols somewhere led on."""
        return self.shortest <= len(value) <= self.longest and self.anywhere.keys() >= set(value)

    def _bits(self, at: int, count: int) -> float:
        """-log2 of the share of a step or end that was taken so often in a state. As many as were different there are set aside for those never taken."""
        different = len(self.used[at]) + (self.ended[at] > 0)
        seen = self.reached[at] + max(1, different)
        return math.log2(seen / count) if count else math.log2(seen / max(1, different) * max(1, SYMBOLS + 1 - different))

    def _surprise(self, a: int, b: int) -> float:
        """-log2 of the likelihood of what left and ended in b by the shares of a."""
        return sum(n * self._bits(a, self.used[a].get(s, 0)) for s, n in self.used[b].items()) + self.ended[b] * self._bits(a, self.ended[a])

    def bits(self, value: str) -> float:
        """-log2 of the likelihood of a value.

        Behind a step that was never taken, the automaton goes on where the symbol led most often, or else all symbols are as likely,
        whichever says more.
        """
        at, total, even, least = 0, 0.0, math.log2(SYMBOLS + 1), math.inf
        for k, symbol in enumerate(value, 1):
            total += self._bits(at, self.used[at].get(symbol, 0))
            if symbol in self.step[at]:
                at = self.step[at][symbol]
            else:
                least = min(least, total + (len(value) - k) * even)
                at = self.anywhere.get(symbol, at)
        return min(least, total + self._bits(at, self.ended[at]))


def infer(values: Iterable[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of some values, in any order and with repeats."""
    tree = Automaton()
    for value in sorted(values):
        tree.add(value)
    return tree.merge(alpha)


def learn(found: DataFrame, learned: int = LEARNED, learned_chars: int = LEARNED_CHARS) -> tuple[dict[str, Automaton], Automaton]:
    """(automaton of each kind, automaton of plain tokens) from what scan() found, from at most `learned` different values of each."""

    def sample(values: DataFrame) -> list[str]:
        few = values.where(F.length("value") <= learned_chars).distinct().orderBy(F.xxhash64("value"), "value").limit(learned)
        return [r["value"] for r in few.collect()]

    labelled = found.select(F.explode("spans").alias("s")).select("s.kind", "s.value")
    kinds = {kind: sample(labelled.where(F.col("kind") == kind).select("value")) for kind in KINDS}
    plain = sample(found.select(F.explode("tokens.value").alias("value")))
    formats = {kind: infer(values) for kind, values in kinds.items() if values}
    alike = [{token for token in plain if made.accepts(token)} for made in formats.values()]
    foreign = set().union(*(tokens for tokens in alike if len(tokens) <= FOREIGN * len(plain)))
    return formats, infer(token for token in plain if token not in foreign)


def judge(token: str, formats: dict[str, Automaton], plain: Automaton, least_bits: float = LEAST_BITS, least_rate: float = LEAST_RATE) -> tuple[str | None, float]:
    """(kind of the span that a token adds or None, its log2 likelihood ratio)."""
    fitting = [k for k, made in formats.items() if made.accepts(token)]
    against = plain.bits(token) if fitting else 0.0
    ratio, _, kind = max(((against - formats[k].bits(token), -KINDS.index(k), k) for k in fitting), default=(-math.inf, 0, None))
    return (kind if ratio >= max(least_bits, least_rate * len(token)) else None), ratio


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_bits: float = LEAST_BITS, least_rate: float = LEAST_RATE) -> DataFrame:
    """(id, secrets) of every row: its spans (kind, start, end, value, base, bits) in order; bits is null for a base span.

    Learns the formats from the same rows, in between.
    """
    found = staged(scan(docs, id_col, text_col))
    formats, plain = learn(found)
    shared = docs.sparkSession.sparkContext.broadcast((formats, plain))
    fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("base", pa.bool_()), ("bits", pa.float64())]
    secrets = "array<struct<kind: string, start: int, end: int, value: string, base: boolean, bits: double>>"
    schema = T.StructType([found.schema[id_col], *T._parse_datatype_string(f"secrets {secrets}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats, plain = shared.value
        for batch in batches:
            out = []
            for spans, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows = [{**span, "base": True, "bits": None} for span in spans]
                for token in tokens:
                    kind, ratio = judge(token["value"], formats, plain, least_bits, least_rate)
                    if kind:
                        rows.append({"kind": kind, "start": token["start"], "end": token["start"] + len(token["value"]), "value": token["value"], "base": False, "bits": ratio})
                out.append(sorted(rows, key=lambda r: (r["start"], KINDS.index(r["kind"]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct(fields)))], names=schema.names)

    return found.mapInArrow(run, schema)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["base"])
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = (F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS)
    added = (F.size("secrets") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"), added)
