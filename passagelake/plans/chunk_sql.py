"""The chunker in SQL: what the chunk queries are compared with.

One group of table expressions a separator. A level cuts its spans at the first separator
that they hold, keeps the pieces that are too long for the next level, and packs runs
of the others with a recursive query: from a first piece the chunk goes as far as the
size allows, and the next one begins with the most whole pieces that fit the overlap.
"""

from __future__ import annotations

from ..functions import text
from ..functions.chunk import SEPARATORS


def _quoted(s: str) -> str:
    return " || ".join(["''", *("chr(10)" if c == "\n" else f"'{c}'" for c in s)])


def chunk_ctes(source: str, size: int, overlap: int) -> str:
    """Table expressions that end in ``chunk`` (doc_id, pos, parts, start, text);
    ``source`` selects (doc_id, whole)."""
    seps = [_quoted(s) for s in SEPARATORS]
    out = [f"src AS ({source})", "s0 AS (SELECT doc_id, 0::BIGINT AS lo, length(whole)::BIGINT AS hi, 1 AS sep, whole AS body FROM src WHERE whole <> '')"]
    for k in range(len(SEPARATORS)):
        first = " ".join(f"WHEN sep <= {i} AND contains(body, {s}) THEN {i}" for i, s in enumerate(seps[:-1], 1))
        names = ", ".join(f"({s})" for s in seps)
        out += [
            f"a{k} AS (SELECT *, CASE {first} ELSE {len(seps)} END AS cut FROM s{k})",
            f"""c{k} AS (SELECT doc_id, lo AS span, cut, body, CASE WHEN cut = {len(seps)} THEN list_transform(range(length(body)), lambda i: 1::BIGINT)
                ELSE list_transform(string_split(body, [{names}][cut]), lambda p: (length(p) + length([{names}][cut]))::BIGINT) END AS sizes, hi - lo AS total, length([{names}][cut]) AS extra FROM a{k})""",
            # the last part lacks its separator
            f"d{k} AS (SELECT doc_id, span, cut, body, list_filter(CASE WHEN cut = {len(seps)} THEN sizes ELSE list_concat(sizes[:-2], [sizes[-1] - extra]) END, lambda n: n > 0) AS sizes FROM c{k})",
            f"e{k} AS (SELECT doc_id, span, cut, body, unnest(sizes) AS n, unnest(range(1, len(sizes) + 1)) AS i FROM d{k})",
            f"p{k} AS (SELECT *, (sum(n) OVER w - n)::BIGINT AS off, (sum((n >= {size})::INT) OVER w)::BIGINT AS run FROM e{k} WINDOW w AS (PARTITION BY doc_id, span ORDER BY i))",
            f"s{k + 1} AS (SELECT doc_id, span + off AS lo, span + off + n AS hi, cut + 1 AS sep, substr(body, off + 1, n) AS body FROM p{k} WHERE n >= {size})",
            f"r{k} AS (SELECT doc_id, span, run, min(span + off) AS lo, list_concat([0::BIGINT], list((off + n)::BIGINT ORDER BY i)) AS ends, min(off) AS base FROM p{k} WHERE n < {size} GROUP BY doc_id, span, run)",
            # ends: places of the cuts of a run, from 0
            f"q{k} AS (SELECT doc_id, span, run, lo, list_transform(ends, lambda e, i: CASE WHEN i = 1 THEN 0 ELSE e - base END) AS ends FROM r{k})",
            f"""g{k} AS (
                SELECT doc_id, span, run, lo, ends, 1::BIGINT AS f, {_reach('1', size)} AS e FROM q{k}
                UNION ALL
                SELECT doc_id, span, run, lo, ends, f, {_reach('f', size)} FROM (
                    SELECT doc_id, span, run, lo, ends,
                        list_min(list_filter(range(f, e + 1), lambda x: ends[e] - ends[x] <= {overlap} AND (ends[e + 1] - ends[x] <= {size} OR x = e)))::BIGINT AS f
                    FROM g{k} WHERE e < len(ends)))""",
            f"h{k} AS (SELECT doc_id, lo + ends[f] AS lo, lo + ends[e] AS hi FROM g{k})",
        ]
    spans = " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(len(SEPARATORS)))
    blank = f"[{text.SPACE}]"
    out += [
        f"spans AS ({spans})",
        "raws AS (SELECT doc_id, lo, substr(whole, lo + 1, hi - lo) AS raw FROM spans JOIN src USING (doc_id))",
        f"bare AS (SELECT doc_id, lo + length(raw) - length(regexp_replace(raw, '^{blank}+', '')) AS start, regexp_replace(raw, '^{blank}+|{blank}+$', '', 'g') AS text FROM raws)",
        "chunk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, length(text))::BIGINT AS pos, count(*) OVER (PARTITION BY doc_id)::BIGINT AS parts, start::BIGINT AS start, text FROM bare WHERE text <> '')",
    ]
    return "RECURSIVE " + ",\n".join(out)


def _reach(first: str, size: int) -> str:
    """The last cut that a chunk from cut ``first`` may end at."""
    return f"list_max(list_filter(range({first} + 1, len(ends) + 1), lambda x: x = {first} + 1 OR ends[x] - ends[{first}] <= {size}))::BIGINT"
