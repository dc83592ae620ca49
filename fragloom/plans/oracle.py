"""SQL of the registered queries, for an engine that has the tables as views."""

from __future__ import annotations

ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
FRAGS = f"""frags AS (
  SELECT 'map' || l_suppkey AS map_id, l_suppkey AS suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER}) - 1 AS INTEGER) AS frag_idx,
         CAST(floor(l_extendedprice) AS INTEGER) AS size
  FROM lineitem),
ends AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY map_id ORDER BY frag_idx) AS BIGINT) AS end_bp FROM frags),
maps AS (SELECT map_id, suppkey, CAST(count(*) AS INTEGER) AS num_frags, CAST(sum(size) AS BIGINT) AS length FROM frags GROUP BY 1, 2)"""

#: Contig fragments after noise and merge, in the contig's own order: contig_id, idx (from 0), size; in the map's order: i; and contig facts.
CONTIGS = f"""{FRAGS},
cuts AS (
  SELECT m.suppkey, m.map_id AS true_map, s.s_nationkey AS genome, (m.suppkey * 37) % (m.num_frags - 20) AS true_start, 10 + m.suppkey % 10 AS n
  FROM maps m JOIN supplier s ON s.s_suppkey = m.suppkey WHERE m.num_frags > 40),
noisy AS (
  SELECT c.suppkey, c.n, c.genome, f.frag_idx - c.true_start AS i, f.frag_idx, f.size AS o_size, f.end_bp, f.size + ((f.frag_idx - c.true_start) * 7) % 11 - 5 AS size
  FROM cuts c JOIN ends f ON f.map_id = c.true_map AND f.frag_idx >= c.true_start AND f.frag_idx < c.true_start + c.n),
joined AS (
  SELECT suppkey, n, genome, CASE WHEN suppkey % 3 = 0 AND i >= 3 THEN i - 1 ELSE i END AS i, size, frag_idx, o_size, end_bp FROM noisy),
merged AS (
  SELECT suppkey, genome, i, CAST(sum(size) AS BIGINT) AS size, CASE WHEN suppkey % 3 = 0 THEN n - 1 ELSE n END AS m,
         min(frag_idx) AS o_start, max(frag_idx) + 1 AS o_end, CAST(sum(o_size) AS BIGINT) AS o_size, max(end_bp) AS o_end_bp, string_agg(CAST(o_size AS VARCHAR), '  ' ORDER BY frag_idx) AS o_text
  FROM joined GROUP BY suppkey, genome, i, n),
contigs AS (
  SELECT 'contig' || suppkey AS contig_id, 'map' || suppkey AS map_id, genome, CAST(CASE WHEN suppkey % 2 = 0 THEN i ELSE m - 1 - i END AS INTEGER) AS idx, size, CAST(m AS INTEGER) AS m FROM merged)"""

#: What the best alignment is by construction: a chunk for each query fragment, on the fragments that it was made of, in the map's order.
TRUTH = f"""{CONTIGS},
truth AS (
  SELECT 'contig' || suppkey AS contig_id, 'contig' || suppkey || '/1' AS match_id, 'map' || suppkey AS chromosome, suppkey % 2 = 0 AS forward, i, m, size AS c, o_size AS o, o_start, o_end, o_text,
    i = 0 OR i = m - 1 AS boundary, CAST((size - o_size) * (size - o_size) AS DOUBLE) / (CAST(size AS DOUBLE) * 100.0::DOUBLE) AS chi2, -5.0::DOUBLE * (o_end - o_start - 1) AS optical
  FROM merged)"""

PLACEMENTS = f"""{FRAGS},
n_sup AS (SELECT count(*) AS n FROM supplier),
base AS (
  SELECT s_suppkey AS k, j, (s_suppkey + 3 * j) % (SELECT n FROM n_sup) AS suppkey FROM supplier, (VALUES (0), (1), (2), (3)) t(j)),
placed AS MATERIALIZED (
  SELECT b.k, b.j, m.map_id, CAST((37 * b.k + 101 * b.j) % (m.num_frags - 20) AS INTEGER) AS s, CAST(10 + (b.k + b.j) % 10 AS INTEGER) AS len
  FROM base b JOIN maps m USING (suppkey)),
matches AS MATERIALIZED (
  SELECT p.k || '/' || p.j AS match_id, 'contig' || p.k AS contig_id, p.len AS num_frags, p.map_id AS chromosome, (p.k + p.j) % 2 = 0 AS forward,
    -CAST((p.k * 31 + p.j * 17) % 97 AS DOUBLE) / 4.0 AS score, CAST((p.k * 13 + p.j * 29) % 100 AS DOUBLE) / 1000.0 AS pval, p.s AS op_start_index, p.s + p.len - 1 AS op_end_index,
    CAST(a.end_bp - a.size AS INTEGER) AS op_start_bp, CAST(z.end_bp AS INTEGER) AS op_end_bp, CAST(z.end_bp - (a.end_bp - a.size) + p.k % 7 AS INTEGER) AS c_aligned_bases,
    CAST(p.len - 1 - p.k % 3 AS INTEGER) AS contig_hits, CAST((p.k + p.j) % 4 AS INTEGER) AS contig_misses, CAST(p.k % 2 AS INTEGER) AS optical_misses,
    CASE WHEN (p.k + p.j) % 4 = 0 THEN 0.0::DOUBLE ELSE ((p.k + p.j) % 4)::DOUBLE / (p.len - 1 - p.k % 3 + (p.k + p.j) % 4) END AS contig_miss_rate,
    CASE WHEN p.k % 2 = 0 THEN 0.0::DOUBLE ELSE (p.k % 2)::DOUBLE / (p.len - 1 - p.k % 3 + p.k % 2) END AS optical_miss_rate,
    p.len - 2 AS inner_blocks, CAST((p.k * 7 + p.j) % 40 * (p.len - 2) AS DOUBLE) / 3.0 AS chi2, 1 - CAST((p.k + p.j) % 15 AS DOUBLE) / 100.0 AS aligned_length_ratio
  FROM placed p JOIN ends a ON a.map_id = p.map_id AND a.frag_idx = p.s JOIN ends z ON z.map_id = p.map_id AND z.frag_idx = p.s + p.len - 1)"""


def on(base: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{base}{select if select.lstrip().startswith(',') else ' ' + select}"


def greedy_sql(base: str, by: str, order: str, start: str, end: str, clash: str, select: str) -> str:
    """Greedy selection as a recursion over ranks; ``clash`` compares candidate c with an accepted struct y."""
    return f"""WITH RECURSIVE {base},
ranked AS (SELECT match_id, {by} AS grp, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS r, {start} AS s, {end} AS e FROM matches),
steps AS (
  SELECT grp, r, match_id, TRUE AS ok, [struct_pack(s := s, e := e)] AS acc FROM ranked WHERE r = 1
  UNION ALL
  SELECT c.grp, c.r, c.match_id, len(list_filter(t.acc, lambda y: {clash})) = 0,
         CASE WHEN len(list_filter(t.acc, lambda y: {clash})) = 0 THEN list_append(t.acc, struct_pack(s := c.s, e := c.e)) ELSE t.acc END
  FROM steps t JOIN ranked c ON c.grp = t.grp AND c.r = t.r + 1)
{select}"""


def dp_sql(local: bool, delta: int = 5, by_count: bool = False) -> str:
    """Score tables as a recursion over query prefixes: a query's state is the last rows of its table, as lists; a new row is worked out from them place by place."""
    reach = delta + 1 if local or by_count else delta
    chi2 = "((x.len - (os[j + 1] - os[j - w + 1])) ** 2)::DOUBLE / (x.len * 100.0::DOUBLE)"
    free = "(x.edge AND x.len < os[j + 1] - os[j - w + 1])"
    if local:
        value, fits = f"-1.25::DOUBLE * ({chi2} - 4.0::DOUBLE) + (x.cost - 5.0::DOUBLE * (w - 1))", f"NOT x.edge AND {chi2} <= 16.0"
    else:
        value, fits = f"(x.cost - 5.0::DOUBLE * (w - 1)) - CASE WHEN {free} THEN 0.0::DOUBLE ELSE {chi2} END", f"({free} OR {chi2} <= 16.0)"
    near = "least(cs[i - k + t + 1] - cs[i - k + 1], cs[i + 1] - cs[i - k + t + 1])"
    step = f"CASE WHEN {near} > 2000 THEN -3.0::DOUBLE WHEN {near} < 2000 THEN -({near}) * 0.0015::DOUBLE + 0.000001::DOUBLE END"
    cost = "-3.0::DOUBLE * (k - 1)" if local or by_count else f"CASE WHEN k = 1 THEN 0.0::DOUBLE WHEN list_count(list_transform(range(1, k), lambda t: {step})) = k - 1 THEN list_sum(list_transform(range(1, k), lambda t: {step})) END"
    best = f"list_max(list_transform(blocks, lambda x: list_max(list_transform(range(1, least(j, {reach}) + 1), lambda w: CASE WHEN {fits} THEN rows[x.k][j - w + 1] + ({value}) END))))"
    if local:
        cell = f"greatest(0.0::DOUBLE, coalesce({best}, 0.0::DOUBLE))"
    else:
        gap = "CASE WHEN c[i] < 2000 THEN rows[1][j + 1] - c[i] * 0.0015::DOUBLE END"
        cell = f"list_max([{best}, {gap}])"
    shown = (
        "max(top) AS top, CAST(sum(found) AS BIGINT) AS cells" if local else "max(top) FILTER (i = m) AS top, CAST(max(found) FILTER (i = m) AS BIGINT) AS cells"
    )
    counted = "list_filter(r[2:], lambda y: y > 0)" if local else "list_filter(r[2:], lambda y: y IS NOT NULL)"
    return f"""WITH RECURSIVE {CONTIGS},
cq AS (SELECT contig_id, map_id, max(m) AS m, list(size ORDER BY idx) AS c FROM contigs GROUP BY 1, 2),
oq AS (SELECT map_id, list_prepend(0, list(end_bp ORDER BY frag_idx)) AS os FROM ends GROUP BY 1),
facts AS (SELECT contig_id, map_id, m, c, list_transform(range(0, m + 1), lambda j: coalesce(list_sum(c[1:j]), 0)) AS cs, os FROM cq JOIN oq USING (map_id)),
fold AS (
  SELECT contig_id, 0 AS i, [list_transform(os, lambda x: 0.0::DOUBLE)] AS rows, NULL::DOUBLE AS top, 0::BIGINT AS found FROM facts
  UNION ALL
  SELECT contig_id, i, list_prepend(r, rows)[1:{reach}], list_max({counted}), len({counted}) FROM (
    SELECT contig_id, i, rows, list_transform(range(0, len(os)), lambda j: {cell}) AS r FROM (
      SELECT *, list_filter(list_transform(range(1, least(i, {reach}) + 1), lambda k: struct_pack(k := k, len := cs[i + 1] - cs[i - k + 1], edge := i = m OR i = k, cost := {cost})), lambda x: x.cost IS NOT NULL AND x.len > 0) AS blocks
      FROM (SELECT f.contig_id, f.i + 1 AS i, f.rows, z.m, z.c, z.cs, z.os FROM fold f JOIN facts z USING (contig_id) WHERE f.i < z.m))))
SELECT contig_id, map_id, round(top + 1e-9::DOUBLE, 6) AS score, cells FROM (SELECT contig_id, map_id, {shown} FROM fold JOIN facts USING (contig_id) WHERE i > 0 GROUP BY 1, 2)"""
