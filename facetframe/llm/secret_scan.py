"""Secret scan: one deterministic automaton for all rules, one pass over the bytes of a text.

Every rule has a *trigger* (the part of a match that proves one has begun). All triggers
are compiled into a single minimised automaton that reads each byte once. Where it
accepts, the rule's reversed trigger finds the leftmost start, not before the end of
the rule's last match, and the rule's own automaton the longest end. Matches of one
rule do not overlap; matches whose tail is too short are dropped but still use up
their text. A read without a match leaves its states at every eighth byte behind; a
later read that comes to one of them ends there, so the time is linear in the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Table, compile_patterns, parse, reverse
from .common import arrow_map, whole_text


class Rule(NamedTuple):
    """``head`` and ``tail`` together are the pattern; the tail of a kept match has ``least`` bytes or more.

    ``trigger`` must be how every match of the pattern that can be kept begins.
    """

    kind: str
    head: str
    tail: str
    trigger: str
    least: int = 0
    ignore_case: bool = False


_NAMES = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]"
#: Fixed: the three rules every scan has, in their order.
BASE_RULES = (
    Rule("assign", _NAMES, _VALUE + "+", _NAMES + _VALUE, 6, ignore_case=True),
    Rule("access", "AKIA", "[A-Z0-9]+", "AKIA[A-Z0-9]{16}", 16),
    Rule("hex", "", "[0-9a-f]+", "[0-9a-f]{24}", 24),
)
#: What may stand between the words of a key body: white space, also escaped, and signs of quoting.
_BETWEEN = r"""[\x20\t\r\n\x5C"',>|#*]"""
#: From the header to the END line whatever stands between; without one, header fields, base64 words and a short last one.
_PEM_BODY = (
    "((-{0,4}[^-])*-----END [A-Z ]*PRIVATE KEY-----"
    f"|(({_BETWEEN}*[A-Z][A-Za-z]*-[A-Za-z]+:\\x20*[A-Za-z0-9,-]+)*({_BETWEEN}*[A-Za-z0-9+/=]{{16,}})+({_BETWEEN}+[A-Za-z0-9+/=]+)?)?)"
)
#: Fixed: published formats of private keys and service tokens.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", _PEM_BODY, "-----BEGIN "),
    Rule("github", "gh[oprsu]_", "[A-Za-z0-9]{36,}", "gh[oprsu]_", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]{10,}", "xox[abprs]-", 10),
    Rule("jwt", "eyJ", r"[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
)
RULES = BASE_RULES + MORE_RULES

Span = tuple[str, int, int]


class Compiled(NamedTuple):
    """The automata of a rule set, ready to be sent to tasks."""

    rules: tuple[Rule, ...]
    search: tuple
    starts: tuple
    whole: tuple
    heads: tuple


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Compiled:
    def trees(part: Callable[[Rule], str]) -> list[tuple]:
        return [parse(part(r), r.ignore_case) for r in rules]

    triggers = trees(lambda r: r.trigger)
    return Compiled(
        tuple(rules), tuple(compile_patterns(triggers, search=True)),
        tuple(tuple(compile_patterns([reverse(t)])) for t in triggers),
        tuple(tuple(compile_patterns([t])) for t in trees(lambda r: r.head + r.tail)),
        tuple(tuple(compile_patterns([t])) for t in trees(lambda r: r.head)),
    )


def scanner(compiled: Compiled) -> Callable[[bytes], list[tuple[int, int, int]]]:
    """A function from UTF-8 bytes to (rule number, start, end) in bytes, by start and rule."""
    rules = compiled.rules
    classes = compiled.search[0]
    search = Table(*compiled.search).rows()[0]
    last = len(search) - 1

    def machine(table: tuple) -> tuple[bytes, list, list | None]:
        """Byte classes, first state, and the state without a way out."""
        rows = Table(*table).rows()
        return table[0], rows[0], next((r for r in rows if not r[-1] and all(t is r for t in r[:-1])), None)

    starts, whole, heads = ([machine(t) for t in part] for part in (compiled.starts, compiled.whole, compiled.heads))

    def longest(machine: tuple, data: bytes, start: int, failed: set | None = None) -> int:
        """``failed`` holds (place, state) from which no match came, as far as reads without a match went."""
        kinds, state, dead = machine
        end = start if state[-1] else -1
        passed = []
        for at in range(start, len(data)):
            state = state[kinds[data[at]]]
            if state[-1]:
                end = at + 1
            elif state is dead:
                break
            elif failed is not None and end < 0 and not at & 7:
                mark = (at, id(state))
                if mark in failed:
                    break
                passed.append(mark)
        if failed is not None and end < 0:
            failed.update(passed)
        return end

    def leftmost(machine: tuple, data: bytes, end: int, least: int) -> int:
        kinds, state, dead = machine
        start = -1
        for at in range(end - 1, least - 1, -1):
            state = state[kinds[data[at]]]
            if state[-1]:
                start = at
            elif state is dead:
                break
        return start

    def scan(data: bytes) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        done = [0] * len(rules)
        failed: list[set] = [set() for _ in rules]
        state, at = search, 0
        for kind in data.translate(classes):
            state = state[kind]
            at += 1
            if state[last]:
                mask = state[last]
                for i, rule in enumerate(rules):
                    if not mask >> i & 1 or at <= done[i]:
                        continue
                    start = leftmost(starts[i], data, at, done[i])
                    end = longest(whole[i], data, start, failed[i]) if start >= 0 else -1
                    if end < 0:
                        continue
                    done[i] = end
                    if end - longest(heads[i], data, start) >= rule.least:
                        found.append((i, start, end))
        found.sort(key=lambda f: (f[1], f[0]))
        return found

    return scan


def in_code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points."""
    edges = sorted({e for _, a, b in found for e in (a, b)})
    points, before, count = {}, 0, 0
    for edge in edges:
        count += len(data[before:edge].decode("utf-8", "surrogatepass"))
        points[edge], before = count, edge
    return [(i, points[a], points[b]) for i, a, b in found]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, counts and digest of the base rules, and all spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then by
    the order of the rules. Null and empty texts have no spans (empty strings, digest
    of the empty string). Repeated rows give repeated rows. Long texts are read once.
    """
    compiled = compile_rules(rules)
    base = {r.kind for r in BASE_RULES}

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(compiled)
        kinds = [r.kind for r in rules]
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in ("assign", "access", "hex")}
            digests, texts = [], []
            for text in batch.column(1).to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                found = scan(data)
                named = [(kinds[i], a, b) for i, a, b in (in_code_points(data, found) if found else ())]
                for k, column in counts.items():
                    column.append(sum(n == k for n, _, _ in named))
                digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in named if k in base).encode()).hexdigest())
                texts.append(",".join(f"{k}:{a}:{b}" for k, a, b in named))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(digests), pa.array(texts)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text()).mapInArrow(
        spans, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same documents with every span replaced by ``[kind]``; overlapping spans become one, named by the first.

    Null texts stay null. ``n_chars``, if there is such a column, counts the new text.
    All rows and columns are kept.
    """
    compiled = compile_rules(rules)
    at, names = docs.columns.index("text"), docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(compiled)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for row, text in enumerate(texts):
                data = (text or "").encode("utf-8", "surrogatepass")
                found = scan(data)
                if not found:
                    continue
                out, before = [], 0
                for i, a, b in found:
                    if a >= before:
                        out += [data[before:a], f"[{rules[i].kind}]".encode()]
                    before = max(before, b)
                texts[row] = b"".join([*out, data[before:]]).decode("utf-8", "surrogatepass")
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    cleaned = arrow_map(docs, clean, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return cleaned


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB: matches and the gaps between them give the places.

    Rules with a least length and a repeated tail say it in the pattern, where that
    means the same; ``assign`` is filtered afterwards, like here. Letters in either
    case are written out, because case folding there goes beyond ASCII.
    """

    def either(pattern: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)

    parts = []
    for order, rule in enumerate(rules):
        head, tail = rule.head, rule.tail
        if rule.ignore_case:
            names, rest = head[: head.index(")") + 1], head[head.index(")") + 1 :]
            head = either(names) + rest
        elif rule.least and tail.endswith("+"):
            tail = f"{tail[:-1]}{{{rule.least},}}"
        pattern = f"{head}({tail})" if tail else f"{head}()"
        group = 2 if rule.ignore_case else 1
        least = rule.least if rule.ignore_case else 0
        quoted = pattern.replace("'", "''")
        parts.append(
            f"SELECT r, '{rule.kind}' AS kind, {order} AS ord, {least} AS least, regexp_extract_all(t, '{quoted}') AS hit,"
            f" regexp_extract_all(t, '{quoted}', {group}) AS val, string_split_regex(t, '{quoted}') AS gap FROM d WHERE regexp_matches(t, '{quoted}')"
        )
    spans = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
i AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM m),
p AS (SELECT r, kind, ord, len(hit[i]) AS size, coalesce(list_sum(list_transform(gap[1:i], lambda x: len(x))), 0)
        + coalesce(list_sum(list_transform(hit[1:i-1], lambda x: len(x))), 0) AS start FROM i WHERE len(val[i]) >= least),
g AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
        count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base,
        string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, ord) AS spans FROM p GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""
    return spans.replace("{parts}", " UNION ALL ".join(parts)).strip()
