"""DuckDB SQL of the operators whose rounds or levels are spelled out one by one."""

from __future__ import annotations


def clusters(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, round by round."""
    nearest = """a{i} AS (SELECT r, arg_min(c, p) AS c, min(p)[1] AS d FROM (SELECT r, c.c, [CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), c.c] AS p FROM k CROSS JOIN c{i} c) GROUP BY r)"""
    moved = """m{j} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT a.c, k.v, unnest(range(1, 65)) AS i FROM a{i} a JOIN k USING (r)) GROUP BY c, i),
 c{j} AS (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{j} GROUP BY c) n USING (c))"""
    steps = [part.format(i=i, j=i + 1) for i in range(rounds) for part in (nearest, moved)] + [nearest.format(i=rounds)]
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 c0 AS (SELECT CAST(o - 1 AS BIGINT) AS c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) AS o FROM k) WHERE o <= {k}),
 {", ".join(steps)}
 SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
 FROM a{rounds} a JOIN k USING (r) JOIN c{rounds} f ON f.c = a.c"""


def merkle(levels: int = 12) -> str:
    """Trees of up to 8 ^ levels leaves, level by level; the checksum bit by bit."""
    crc = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END)))"
    size = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    head = " || ".join(size(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(t: str, leaves: str) -> list[str]:
        """{t}0, {t}1 ... by (g, p, n, h): group, place, nodes, digest; siblings {t}s1 ... of each node by (g, p, others, before, after)."""
        out = [f"{t}0 AS MATERIALIZED ({leaves})"]
        for i in range(1, levels + 1):
            last = f"{t}{i - 1}"
            out.append(f"{t}{i} AS MATERIALIZED (SELECT g, p // 8 AS p, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h FROM {last} GROUP BY g, p // 8)")
            w = "OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN {0})"
            before, after = w.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), w.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
            out.append(f"{t}s{i} AS MATERIALIZED (SELECT g, p, n, coalesce(string_agg(h, '') {before}, '') AS b, coalesce(string_agg(h, '') {after}, '') AS a FROM {last})")
        return out

    def folded(t: str, source: str, g: str, p: str) -> list[str]:
        """The rows of a table with proof and digest carried from level to level."""
        out = []
        for i in range(1, levels + 1):
            last = source if i == 1 else f"{t}f{i - 1}"
            out.append(f"{t}f{i} AS MATERIALIZED (SELECT f.* EXCLUDE (proof, now), f.proof || s.b || s.a AS proof, CASE WHEN s.n > 1 THEN sha256(s.b || f.now || s.a) ELSE f.now END AS now FROM {last} f JOIN {t}s{i} s ON s.g = f.{g} AND s.p = f.{p} // {8 ** (i - 1)})")
        return out

    parts = [
        f"d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({head} || {size('text')}) AS h, CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {size(low)}) ELSE sha256({head} || {size('text')}) END AS now FROM documents)",
        "l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM d)",
        *tree("t", "SELECT g, p, n, h FROM l"),
        f"r AS MATERIALIZED (SELECT g AS sub, h, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM t{levels})",
        *tree("u", "SELECT '' AS g, p, n, h FROM r"),
        "lf0 AS (SELECT doc_id, h AS leaf, g, p, '' AS proof, now FROM l)",
        *folded("t", "lf0", "g", "p"),
        f"uf0 AS (SELECT f.*, r.h AS subroot, '' AS ug, r.p AS up FROM tf{levels} f JOIN r ON r.sub = f.g)",
        *folded("u", "uf0", "ug", "up"),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = u.h AS verified, CAST(length(proof) // 64 AS BIGINT) AS n_siblings FROM uf{levels} f CROSS JOIN u{levels} u"


def substrings(width: int = 13) -> str:
    """Every window with the least id that has it."""
    return rf"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 x AS MATERIALIZED (SELECT r, doc_id, unnest(list_transform(range(1, len(w) - {width - 2}), lambda i: {{'i': i, 'k': array_to_string(w[i:i+{width - 1}], ' ')}})) AS u FROM w WHERE len(w) >= {width}),
 m AS (SELECT u.k AS k, min(doc_id) AS f FROM x GROUP BY 1),
 c AS (SELECT DISTINCT r, unnest(range(u.i, u.i + {width})) AS i FROM x JOIN m ON m.k = x.u.k WHERE x.doc_id > m.f),
 y AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
 k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM y ANTI JOIN c USING (r, i) GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)"""
