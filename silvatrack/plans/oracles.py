"""DuckDB SQL for the queries: common table expressions for the steps, and a SELECT for each query."""

from __future__ import annotations

import re

_SF = "1 - list_sum(list_transform(range(0, CAST({n} AS BIGINT) + 1), lambda j: exp(-rate + j * ln(rate) - lgamma(j + 1))))"

_L1 = "list_sum(list_transform(range(1, len(v.x) + 1), lambda j: abs(v.x[j] - c.x[j])))"
_FAR = f"SELECT v.id, v.x, min({_L1}) AS d FROM vec v, {{}} c GROUP BY v.id, v.x"


def _draw(number: int, id_: str = "id") -> str:
    """A number between 0 and 1 from 52 bits of a hash of the id and the draw's number."""
    return f"((CAST('0x' || substr(md5({id_} || ':{number}:0'), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"


STEPS = {
    "b": ("", """SELECT r.r_name AS species, concat(l_returnflag, l_linestatus) AS mark, CAST(1 + l_partkey % 2 AS INT) AS rep,
  CASE WHEN l_orderkey // 3750 = 3 THEN 'chrX' ELSE concat('chr', l_orderkey // 3750) END AS chrom,
  CAST(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) * 200 + (l_partkey * 37 + l_linenumber * 11) % 200 AS BIGINT) AS pos,
  l_linenumber % 2 = 0 AS paired, l_partkey % 5 <> 0 AS proper, l_orderkey, l_quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey"""),
    "reads": ("b", """SELECT species, mark, rep, chrom, pos, CAST(CASE WHEN paired THEN pos + 150 ELSE 0 END AS BIGINT) AS mpos, CAST(36 AS INT) AS rlen,
  CAST((CASE WHEN paired THEN 1 ELSE 0 END) + (CASE WHEN paired AND proper THEN 2 ELSE 0 END) + (CASE WHEN l_orderkey % 32 = 5 THEN 1024 ELSE 0 END) AS INT) AS flag,
  CAST(CASE WHEN l_quantity = 1 THEN 0 ELSE 37 END AS INT) AS mapq FROM b"""),
    "sizes": ("", """SELECT chrom, length, length // 2000 AS bins FROM (SELECT CASE WHEN c = 3 THEN 'chrX' ELSE concat('chr', c) END AS chrom, CAST(500000 - c % 3 * 1250 AS BIGINT) AS length
  FROM (SELECT unnest(range(0, max(l_orderkey) // 3750 + 1)) AS c FROM lineitem)) WHERE chrom NOT IN ('chrM', 'chrY', 'chrX')"""),
    "good": ("reads", "SELECT * FROM reads WHERE flag & 1796 = 0 AND mapq > 0"),
    "kept": ("good sizes", """SELECT species, mark, rep, good.chrom, pos, flag,
  least(bins - 1, (CASE WHEN flag & 1 <> 0 THEN (pos + mpos + rlen) // 2 ELSE pos + 100 END) // 2000) AS bin
  FROM good JOIN sizes ON good.chrom = sizes.chrom WHERE flag & 1 = 0 OR flag & 2 <> 0"""),
    "counts": ("kept", "SELECT species, mark, chrom, bin, count(*) AS n FROM kept GROUP BY ALL"),
    "rates": ("counts sizes", """SELECT species, mark, CAST(sum(n) AS BIGINT) AS total, CAST(sum(bins) AS BIGINT) AS total_bins, sum(n) / CAST(sum(bins) AS DOUBLE) AS rate
  FROM (SELECT species, mark, chrom, sum(n) AS n FROM counts GROUP BY ALL) c JOIN sizes ON c.chrom = sizes.chrom GROUP BY species, mark"""),
    "zero": ("rates", f"SELECT species, mark, {_SF.format(n=0)} < CAST(0.1 AS DOUBLE) AS every FROM rates"),
    "calls": ("counts rates zero sizes", f"""SELECT c.species, c.mark, c.chrom, c.bin FROM counts c JOIN rates r ON c.species = r.species AND c.mark = r.mark
  JOIN zero z ON c.species = z.species AND c.mark = z.mark WHERE NOT z.every AND {_SF.format(n='n')} < CAST(0.1 AS DOUBLE)
  UNION ALL SELECT species, mark, chrom, unnest(range(0, bins)) AS bin FROM zero, sizes WHERE every"""),
    "species_dim": ("reads", "SELECT species, CAST(row_number() OVER (ORDER BY species) - 1 AS INT) AS i FROM (SELECT DISTINCT species FROM reads)"),
    "mark_dim": ("reads", "SELECT mark, CAST(row_number() OVER (ORDER BY mark) - 1 AS INT) AS l FROM (SELECT DISTINCT mark FROM reads)"),
    "cells": ("calls species_dim mark_dim", "SELECT i, l, chrom, bin FROM calls JOIN species_dim s ON calls.species = s.species JOIN mark_dim m ON calls.mark = m.mark"),
    "avail": ("counts species_dim mark_dim", "SELECT DISTINCT i, l FROM counts JOIN species_dim s ON counts.species = s.species JOIN mark_dim m ON counts.mark = m.mark"),
    "grid": ("sizes", "SELECT chrom, unnest(range(0, bins)) AS bin FROM sizes"),
    "density": ("calls", "SELECT chrom, bin, CAST(count(*) AS DOUBLE) AS d FROM calls GROUP BY ALL"),
    "kern5": ("", "SELECT x, exp(-x * x / CAST(5 AS DOUBLE)) / sum(exp(-x * x / CAST(5 AS DOUBLE))) OVER () AS k FROM (SELECT unnest(range(-5, 6)) AS x)"),
    "kern3": ("", "SELECT x, exp(-x * x / CAST(3 AS DOUBLE)) / sum(exp(-x * x / CAST(3 AS DOUBLE))) OVER () AS k FROM (SELECT unnest(range(-3, 4)) AS x)"),
    "smooth": ("density kern5 sizes", """SELECT d.chrom, d.bin + x AS bin, round(sum(d * k), 9) AS s FROM density d, kern5 JOIN sizes z ON z.chrom = d.chrom
  WHERE d.bin + x >= 0 AND d.bin + x < bins GROUP BY d.chrom, d.bin + x"""),
    "runs": ("smooth", """SELECT chrom, min(bin) AS "start", max(bin) + 1 AS "end" FROM (SELECT chrom, bin, bin - row_number() OVER (PARTITION BY chrom ORDER BY bin) AS island
  FROM smooth WHERE s >= CAST(4.5 AS DOUBLE)) GROUP BY chrom, island"""),
    "chunks": ("runs", """SELECT (dense_rank() OVER (ORDER BY chrom) - 1) * 4294967296 + row_number() OVER (PARTITION BY chrom ORDER BY "start") - 1 AS chunk_id, chrom,
  row_number() OVER (PARTITION BY chrom ORDER BY "start") - 1 AS number, "start", "end" FROM runs WHERE "end" - "start" >= 5"""),
    "cut": ("cells chunks", """SELECT chunk_id, i, l, c.chrom, bin, bin - "start" AS t FROM cells c JOIN chunks k ON c.chrom = k.chrom AND bin >= "start" AND bin < "end" """),
    "nodes": ("chunks", """SELECT chunk_id, chrom, bin, bin - "start" AS t, i FROM (SELECT *, unnest(range("start", "end")) AS bin FROM chunks), (SELECT CAST(unnest(range(0, 5)) AS INT) AS i)"""),
    "st": ("", "SELECT CAST(unnest(range(0, 3)) AS INT) AS k"),
    "q": ("nodes st", """SELECT chunk_id, chrom, bin, t, i, k, w / sum(w) OVER (PARTITION BY chunk_id, bin, i) AS q FROM
  (SELECT nodes.*, k, CAST(1 + (i * 5 + bin * 3 + k * 7) % 11 AS DOUBLE) AS w FROM nodes, st)"""),
    "tree": ("", "SELECT * FROM (VALUES (0, NULL), (1, 0), (2, 0), (3, 2), (4, 2)) v(i, parent)"),
    "emit": ("st", "SELECT k, l, (1 + (k * 7 + l * 3) % 9) / CAST(10 AS DOUBLE) AS e FROM st, (SELECT CAST(unnest(range(0, 6)) AS INT) AS l)"),
    "ll": ("nodes emit avail cells", """SELECT n.chunk_id, n.chrom, n.bin, n.t, n.i, e.k, sum(CASE WHEN c.l IS NULL THEN ln(1 - e.e) ELSE ln(e.e) END) AS ll
  FROM nodes n JOIN avail a ON a.i = n.i JOIN emit e ON e.l = a.l LEFT JOIN cells c ON c.chrom = n.chrom AND c.bin = n.bin AND c.i = n.i AND c.l = a.l GROUP BY ALL"""),
    "gam": ("st", "SELECT k, (1 + k) / CAST(sum(1 + k) OVER () AS DOUBLE) AS p FROM st"),
    "alp": ("st", """SELECT h, k, w / sum(w) OVER (PARTITION BY h) AS p FROM (SELECT a.k AS h, b.k, CAST(1 + (CASE WHEN a.k = b.k THEN 6 ELSE 0 END) + (a.k * 2 + b.k) % 3 AS DOUBLE) AS w FROM st a, st b)"""),
    "bet": ("st", """SELECT v, k, w / sum(w) OVER (PARTITION BY v) AS p FROM (SELECT a.k AS v, b.k, CAST(1 + (CASE WHEN a.k = b.k THEN 4 ELSE 0 END) + (a.k + 2 * b.k) % 3 AS DOUBLE) AS w FROM st a, st b)"""),
    "the": ("st", """SELECT v, h, k, w / sum(w) OVER (PARTITION BY v, h) AS p FROM (SELECT c.k AS v, a.k AS h, b.k,
  CAST(1 + (CASE WHEN a.k = b.k THEN 5 ELSE 0 END) + (CASE WHEN c.k = b.k THEN 3 ELSE 0 END) + (c.k + a.k + b.k) % 2 AS DOUBLE) AS w FROM st a, st b, st c)"""),
    # Expected log of each node's own table entry.
    "own": ("q tree gam alp bet the", """SELECT n.chunk_id, n.i, n.t, n.k, ln(g.p) AS own FROM q n JOIN tree USING (i) JOIN gam g ON g.k = n.k WHERE parent IS NULL AND n.t = 0
  UNION ALL SELECT n.chunk_id, n.i, n.t, n.k, sum(b.q * ln(a.p)) FROM q n JOIN tree USING (i) JOIN q b ON b.chunk_id = n.chunk_id AND b.i = n.i AND b.t = n.t - 1 JOIN alp a ON a.h = b.k AND a.k = n.k WHERE parent IS NULL GROUP BY ALL
  UNION ALL SELECT n.chunk_id, n.i, n.t, n.k, sum(u.q * ln(a.p)) FROM q n JOIN tree USING (i) JOIN q u ON u.chunk_id = n.chunk_id AND u.i = parent AND u.t = n.t JOIN bet a ON a.v = u.k AND a.k = n.k WHERE n.t = 0 GROUP BY ALL
  UNION ALL SELECT n.chunk_id, n.i, n.t, n.k, sum(u.q * b.q * ln(a.p)) FROM q n JOIN tree USING (i) JOIN q u ON u.chunk_id = n.chunk_id AND u.i = parent AND u.t = n.t
  JOIN q b ON b.chunk_id = n.chunk_id AND b.i = n.i AND b.t = n.t - 1 JOIN the a ON a.v = u.k AND a.h = b.k AND a.k = n.k GROUP BY ALL"""),
    "nxt": ("q tree alp the", """SELECT n.chunk_id, n.i, n.t, n.k, sum(f.q * ln(a.p)) AS nxt FROM q n JOIN tree USING (i) JOIN q f ON f.chunk_id = n.chunk_id AND f.i = n.i AND f.t = n.t + 1 JOIN alp a ON a.h = n.k AND a.k = f.k WHERE parent IS NULL GROUP BY ALL
  UNION ALL SELECT n.chunk_id, n.i, n.t, n.k, sum(u.q * f.q * ln(a.p)) FROM q n JOIN tree USING (i) JOIN q u ON u.chunk_id = n.chunk_id AND u.i = parent AND u.t = n.t + 1
  JOIN q f ON f.chunk_id = n.chunk_id AND f.i = n.i AND f.t = n.t + 1 JOIN the a ON a.v = u.k AND a.h = n.k AND a.k = f.k GROUP BY ALL"""),
    "kids": ("q tree bet the st", """SELECT c.chunk_id, parent AS i, c.t, s.k, sum(c.q * ln(a.p)) AS kid FROM q c JOIN tree USING (i), st s JOIN bet a ON a.v = s.k AND a.k = c.k WHERE parent IS NOT NULL AND c.t = 0 GROUP BY ALL
  UNION ALL SELECT c.chunk_id, parent, c.t, s.k, sum(c.q * b.q * ln(a.p)) FROM q c JOIN tree USING (i) JOIN q b ON b.chunk_id = c.chunk_id AND b.i = c.i AND b.t = c.t - 1, st s
  JOIN the a ON a.v = s.k AND a.h = b.k AND a.k = c.k WHERE parent IS NOT NULL GROUP BY ALL"""),
    "jac": ("q own nxt kids ll", """SELECT chunk_id, i, t, k, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY chunk_id, i, t) AS q FROM (SELECT *, max(z) OVER (PARTITION BY chunk_id, i, t) AS m FROM
  (SELECT n.chunk_id, n.i, n.t, n.k, own + coalesce(nxt, 0) + coalesce(kid, 0) + ll AS z FROM q n JOIN own USING (chunk_id, i, t, k) JOIN ll USING (chunk_id, i, t, k)
  LEFT JOIN nxt USING (chunk_id, i, t, k) LEFT JOIN kids USING (chunk_id, i, t, k)))"""),
    "emission": ("q avail cells", """SELECT k, l, (coalesce(present, 0) + CAST(1e-6 AS DOUBLE)) / (total + CAST(2e-6 AS DOUBLE)) AS e FROM (SELECT k, l, sum(q) AS total FROM q JOIN avail USING (i) GROUP BY ALL) a
  LEFT JOIN (SELECT k, c.l, sum(q) AS present FROM q JOIN cells c ON c.chrom = q.chrom AND c.bin = q.bin AND c.i = q.i GROUP BY ALL) b USING (k, l)"""),
    "signal": ("counts rates", "SELECT c.species, c.mark, chrom, bin, asinh(n / (total / CAST(1e6 AS DOUBLE))) AS value FROM counts c JOIN rates r ON c.species = r.species AND c.mark = r.mark"),
    "dense": ("signal sizes", """SELECT g.species, g.mark, g.chrom, g.bin, coalesce(value, CAST(0 AS DOUBLE)) AS value FROM (SELECT s.species, s.mark, s.chrom, unnest(range(0, bins)) AS bin
  FROM (SELECT DISTINCT species, mark, chrom FROM signal) s JOIN sizes ON s.chrom = sizes.chrom) g LEFT JOIN signal v ON v.species = g.species AND v.mark = g.mark AND v.chrom = g.chrom AND v.bin = g.bin"""),
    "vec": ("", "SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings"),
    "near": ("vec", """SELECT id, k, d, row_number() OVER (PARTITION BY id ORDER BY d, k) AS o FROM (SELECT a.id, c.id AS k, list_sum(list_transform(range(1, len(a.x) + 1), lambda j: abs(a.x[j] - c.x[j]))) AS d
  FROM vec a, vec c WHERE c.id IN (0, 1, 2))"""),
    # Spread-out centres: the row with the least draw, two passes of six candidates each, their weights, and three picks by weight and distance.
    "cand0": ("vec", f"SELECT id, x FROM vec ORDER BY {_draw(0)}, id LIMIT 1"),
    "cand1": ("vec cand0", f"SELECT * FROM cand0 UNION ALL (SELECT id, x FROM ({_FAR.format('cand0')}) WHERE d > 0 ORDER BY -ln({_draw(1)}) / (d * d), id LIMIT 6)"),
    "cand2": ("vec cand1", f"SELECT * FROM cand1 UNION ALL (SELECT id, x FROM ({_FAR.format('cand1')}) WHERE d > 0 ORDER BY -ln({_draw(2)}) / (d * d), id LIMIT 6)"),
    "weighed": ("vec cand2", f"""SELECT c.id, c.x, n FROM cand2 c JOIN (SELECT cid, count(*) AS n FROM (SELECT v.id, c.id AS cid, row_number() OVER (PARTITION BY v.id ORDER BY {_L1}, c.id) AS o
  FROM vec v, cand2 c) WHERE o = 1 GROUP BY cid) w ON w.cid = c.id"""),
    "pick0": ("weighed", f"SELECT id, x, n FROM weighed ORDER BY -ln({_draw(1000)}) / n, id LIMIT 1"),
    "pick1": ("weighed pick0", f"SELECT v.id, v.x, v.n FROM weighed v, pick0 c WHERE {_L1} > 0 ORDER BY -ln({_draw(1001, 'v.id')}) / (v.n * pow({_L1}, 2)), v.id LIMIT 1"),
    "pick2": ("weighed pick0 pick1", f"""SELECT id, x, n FROM (SELECT v.id, v.x, v.n, min({_L1}) AS d FROM weighed v, (FROM pick0 UNION ALL FROM pick1) c GROUP BY v.id, v.x, v.n) WHERE d > 0
  ORDER BY -ln({_draw(1002)}) / (n * d * d), id LIMIT 1"""),
    # Two states, each species a chain of its own: scaled forward and backward passes, a row for each node.
    "em2": ("ll chunks", """SELECT chunk_id, i, t, "end" - "start" AS n, max(CASE WHEN k = 0 THEN exp(ll) END) AS e0, max(CASE WHEN k = 1 THEN exp(ll) END) AS e1 FROM ll JOIN chunks USING (chunk_id) GROUP BY ALL"""),
    "fwd": ("em2", """SELECT chunk_id, i, t, n, e0 / 3 / (e0 / 3 + e1 * 2 / 3) AS a0, e1 * 2 / 3 / (e0 / 3 + e1 * 2 / 3) AS a1, ln(e0 / 3 + e1 * 2 / 3) AS lg FROM em2 WHERE t = 0
  UNION ALL SELECT chunk_id, i, t, n, x0 / (x0 + x1), x1 / (x0 + x1), lg + ln(x0 + x1) FROM (SELECT e.chunk_id, e.i, e.t, e.n, f.lg,
  e0 * (a0 * CAST(7 AS DOUBLE) / 9 + a1 * CAST(3 AS DOUBLE) / 10) AS x0, e1 * (a0 * CAST(2 AS DOUBLE) / 9 + a1 * CAST(7 AS DOUBLE) / 10) AS x1
  FROM fwd f JOIN em2 e ON e.chunk_id = f.chunk_id AND e.i = f.i AND e.t = f.t + 1)"""),
    "bwd": ("em2", """SELECT chunk_id, i, t, e0, e1, CAST(1 AS DOUBLE) AS b0, CAST(1 AS DOUBLE) AS b1 FROM em2 WHERE t = n - 1
  UNION ALL SELECT chunk_id, i, t, e0, e1, y0 / (y0 + y1), y1 / (y0 + y1) FROM (SELECT e.chunk_id, e.i, e.t, e.e0, e.e1,
  CAST(7 AS DOUBLE) / 9 * b.e0 * b0 + CAST(2 AS DOUBLE) / 9 * b.e1 * b1 AS y0, CAST(3 AS DOUBLE) / 10 * b.e0 * b0 + CAST(7 AS DOUBLE) / 10 * b.e1 * b1 AS y1
  FROM bwd b JOIN em2 e ON e.chunk_id = b.chunk_id AND e.i = b.i AND e.t = b.t - 1)"""),
    "vit": ("em2", """SELECT chunk_id, i, t, n, ln(e0) + ln(CAST(1 AS DOUBLE) / 3) AS s0, ln(e1) + ln(CAST(2 AS DOUBLE) / 3) AS s1, 0 AS p0, 0 AS p1 FROM em2 WHERE t = 0
  UNION ALL SELECT chunk_id, i, t, n, greatest(x00, x10) + ln(e0), greatest(x01, x11) + ln(e1), CASE WHEN x10 > x00 THEN 1 ELSE 0 END, CASE WHEN x11 > x01 THEN 1 ELSE 0 END FROM (SELECT e.chunk_id, e.i, e.t, e.n, e0, e1,
  s0 + ln(CAST(7 AS DOUBLE) / 9) AS x00, s0 + ln(CAST(2 AS DOUBLE) / 9) AS x01, s1 + ln(CAST(3 AS DOUBLE) / 10) AS x10, s1 + ln(CAST(7 AS DOUBLE) / 10) AS x11
  FROM vit f JOIN em2 e ON e.chunk_id = f.chunk_id AND e.i = f.i AND e.t = f.t + 1)"""),
    "back": ("vit", """SELECT chunk_id, i, t, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS state FROM vit WHERE t = n - 1
  UNION ALL SELECT b.chunk_id, b.i, b.t - 1, CASE WHEN b.state = 0 THEN p0 ELSE p1 END FROM back b JOIN vit v ON v.chunk_id = b.chunk_id AND v.i = b.i AND v.t = b.t WHERE b.t > 0"""),
    # The same forward pass over the continuous signal: means 2 and 5, variances of 4.
    "em2g": ("nodes avail signal species_dim mark_dim chunks", """SELECT chunk_id, i, t, n, exp(CASE WHEN l0 = 0 THEN -100 ELSE l0 END) AS e0, exp(CASE WHEN l1 = 0 THEN -100 ELSE l1 END) AS e1 FROM (SELECT n.chunk_id, n.i, n.t, k."end" - k."start" AS n,
  sum(-CAST(0.5 AS DOUBLE) * (ln(2 * pi() * 4) + (coalesce(v.value, 0) - 2) * (coalesce(v.value, 0) - 2) / 4)) AS l0, sum(-CAST(0.5 AS DOUBLE) * (ln(2 * pi() * 4) + (coalesce(v.value, 0) - 5) * (coalesce(v.value, 0) - 5) / 4)) AS l1
  FROM nodes n JOIN chunks k ON k.chunk_id = n.chunk_id JOIN avail a ON a.i = n.i LEFT JOIN (SELECT i, l, chrom, bin, value FROM signal JOIN species_dim USING (species) JOIN mark_dim USING (mark)) v
  ON v.i = n.i AND v.l = a.l AND v.chrom = n.chrom AND v.bin = n.bin GROUP BY ALL)"""),
    "fwdg": ("em2g", """SELECT chunk_id, i, t, n, e0 / 3 / (e0 / 3 + e1 * 2 / 3) AS a0, e1 * 2 / 3 / (e0 / 3 + e1 * 2 / 3) AS a1, ln(e0 / 3 + e1 * 2 / 3) AS lg FROM em2g WHERE t = 0
  UNION ALL SELECT chunk_id, i, t, n, x0 / (x0 + x1), x1 / (x0 + x1), lg + ln(x0 + x1) FROM (SELECT e.chunk_id, e.i, e.t, e.n, f.lg,
  e0 * (a0 * CAST(7 AS DOUBLE) / 9 + a1 * CAST(3 AS DOUBLE) / 10) AS x0, e1 * (a0 * CAST(2 AS DOUBLE) / 9 + a1 * CAST(7 AS DOUBLE) / 10) AS x1
  FROM fwdg f JOIN em2g e ON e.chunk_id = f.chunk_id AND e.i = f.i AND e.t = f.t + 1)"""),
    # A species without children, its parent's posteriors given: tables of each bin from the expected logs of theta, scaled passes over them.
    "leafe": ("ll chunks", """SELECT chunk_id, t, "end" - "start" AS n, list(exp(ll) ORDER BY k) AS e FROM ll JOIN chunks USING (chunk_id) WHERE i = 1 GROUP BY ALL"""),
    "leaft": ("q the", """SELECT chunk_id, t, list(x ORDER BY h, k) AS f FROM (SELECT q.chunk_id, q.t, h, the.k, exp(sum(q * ln(p))) AS x FROM q JOIN the ON v = q.k WHERE i = 0 GROUP BY ALL) GROUP BY ALL"""),
    "leafs": ("q bet leafe", """SELECT e.chunk_id, n, list(x * e[k + 1] ORDER BY k) AS x FROM (SELECT q.chunk_id, bet.k, exp(sum(q * ln(p))) AS x FROM q JOIN bet ON v = q.k WHERE i = 0 AND t = 0 GROUP BY ALL) s
  JOIN leafe e ON e.chunk_id = s.chunk_id AND e.t = 0 GROUP BY ALL"""),
    "leaff": ("leafs leafe leaft", """SELECT chunk_id, CAST(0 AS BIGINT) AS t, n, list_transform(x, lambda y: y / list_sum(x)) AS a, ln(list_sum(x)) AS lg FROM leafs
  UNION ALL SELECT chunk_id, t, n, list_transform(x, lambda y: y / list_sum(x)), lg + ln(list_sum(x)) FROM (SELECT e.chunk_id, e.t, e.n, lg, list_transform([1, 2, 3], lambda k: e[k] * (a[1] * f[k] + a[2] * f[3 + k] + a[3] * f[6 + k])) AS x
  FROM leaff p JOIN leafe e ON e.chunk_id = p.chunk_id AND e.t = p.t + 1 JOIN leaft w ON w.chunk_id = e.chunk_id AND w.t = e.t)"""),
    "leafb": ("leafe leaft", """SELECT chunk_id, t, [CAST(1 AS DOUBLE), 1, 1] AS b FROM leafe WHERE t = n - 1
  UNION ALL SELECT chunk_id, t, list_transform(y, lambda z: z / list_sum(y)) FROM (SELECT e.chunk_id, e.t - 1 AS t, list_transform([0, 3, 6], lambda h: f[h + 1] * e[1] * b[1] + f[h + 2] * e[2] * b[2] + f[h + 3] * e[3] * b[3]) AS y
  FROM leafb p JOIN leafe e ON e.chunk_id = p.chunk_id AND e.t = p.t JOIN leaft w ON w.chunk_id = p.chunk_id AND w.t = p.t WHERE p.t > 0)"""),
    # Two species, two states: the scaled forward pass over their four joint states (first species' state, second's).
    "pair": ("em2", "SELECT a.chunk_id, a.t, a.n, a.e0 * b.e0 AS e00, a.e0 * b.e1 AS e01, a.e1 * b.e0 AS e10, a.e1 * b.e1 AS e11 FROM em2 a JOIN em2 b ON a.chunk_id = b.chunk_id AND a.t = b.t WHERE a.i = 0 AND b.i = 1"),
    "joint": ("pair", """SELECT chunk_id, t, n, x00 / s AS a00, x01 / s AS a01, x10 / s AS a10, x11 / s AS a11, ln(s) AS lg FROM (SELECT *, x00 + x01 + x10 + x11 AS s FROM
  (SELECT chunk_id, t, n, e00 * CAST(1 AS DOUBLE) / 3 * 5 / 8 AS x00, e01 * CAST(1 AS DOUBLE) / 3 * 3 / 8 AS x01, e10 * CAST(2 AS DOUBLE) / 3 * 2 / 7 AS x10, e11 * CAST(2 AS DOUBLE) / 3 * 5 / 7 AS x11 FROM pair WHERE t = 0))
  UNION ALL SELECT chunk_id, t, n, x00 / s, x01 / s, x10 / s, x11 / s, lg + ln(s) FROM (SELECT *, x00 + x01 + x10 + x11 AS s FROM (SELECT e.chunk_id, e.t, e.n, lg,
  e00 * ((a00 * CAST(7 AS DOUBLE) / 9 + a10 * CAST(3 AS DOUBLE) / 10) * 9 / 11 + (a01 * CAST(7 AS DOUBLE) / 9 + a11 * CAST(3 AS DOUBLE) / 10) * 5 / 11) AS x00,
  e01 * ((a00 * CAST(7 AS DOUBLE) / 9 + a10 * CAST(3 AS DOUBLE) / 10) * 2 / 11 + (a01 * CAST(7 AS DOUBLE) / 9 + a11 * CAST(3 AS DOUBLE) / 10) * 6 / 11) AS x01,
  e10 * ((a00 * CAST(2 AS DOUBLE) / 9 + a10 * CAST(7 AS DOUBLE) / 10) * 7 / 11 + (a01 * CAST(2 AS DOUBLE) / 9 + a11 * CAST(7 AS DOUBLE) / 10) * 1 / 11) AS x10,
  e11 * ((a00 * CAST(2 AS DOUBLE) / 9 + a10 * CAST(7 AS DOUBLE) / 10) * 4 / 11 + (a01 * CAST(2 AS DOUBLE) / 9 + a11 * CAST(7 AS DOUBLE) / 10) * 10 / 11) AS x11
  FROM joint j JOIN pair e ON e.chunk_id = j.chunk_id AND e.t = j.t + 1))"""),
}


def _again(step: str, suffix: str, **names: str) -> None:
    """Adds a step once more, as step + suffix, with other tables in place of those it names."""
    needs, text = STEPS[step]
    swap = lambda n: names.get(n, n)
    unnamed = r"(?= (?:JOIN|LEFT|USING|WHERE|GROUP|ON)\b|\)|$)"  # such a table goes on by the name it had
    text = re.sub(rf"\b(FROM|JOIN) (\w+){unnamed}", lambda m: f"{m[1]} {swap(m[2])} {m[2]}" if m[2] in names else m[0], text)
    STEPS[step + suffix] = " ".join(swap(n) for n in needs.split()), re.sub(r"\b(FROM|JOIN) (\w+)(?= \w)", lambda m: f"{m[1]} {swap(m[2])}", text)


def _sweep(suffix: str, q: str, **tables: str) -> str:
    """Adds the steps of a mean-field sweep over the posteriors q; returns the name of what comes out."""
    for step in ("own", "nxt", "kids"):
        _again(step, suffix, q=q, **tables)
    _again("jac", suffix, q=q, own=f"own{suffix}", nxt=f"nxt{suffix}", kids=f"kids{suffix}", **tables)
    return f"jac{suffix}"


def _estimate(suffix: str, q: str) -> dict[str, str]:
    """Adds the steps of the M-step from the posteriors q; returns which tables take the place of which."""
    share = "SELECT {0}, (w + CAST(1e-6 AS DOUBLE)) / sum(w + CAST(1e-6 AS DOUBLE)) OVER ({1}) AS p FROM (SELECT {2}, sum({3}) AS w FROM {4} GROUP BY ALL)".format
    before, above = f"JOIN {q} b ON b.chunk_id = n.chunk_id AND b.i = n.i AND b.t = n.t - 1", f"JOIN {q} u ON u.chunk_id = n.chunk_id AND u.i = parent AND u.t = n.t"
    node = f"{q} n JOIN tree USING (i)"
    STEPS[f"gam{suffix}"] = f"{q} tree", share("k", "", "n.k", "n.q", f"(SELECT n.* FROM {node} WHERE parent IS NULL AND n.t = 0) n")
    STEPS[f"alp{suffix}"] = f"{q} tree", share("h, k", "PARTITION BY h", "h, k", "x", f"(SELECT b.k AS h, n.k, b.q * n.q AS x FROM {node} {before} WHERE parent IS NULL)")
    STEPS[f"bet{suffix}"] = f"{q} tree", share("v, k", "PARTITION BY v", "v, k", "x", f"(SELECT u.k AS v, n.k, u.q * n.q AS x FROM {node} {above} WHERE n.t = 0)")
    STEPS[f"the{suffix}"] = f"{q} tree", share("v, h, k", "PARTITION BY v, h", "v, h, k", "x", f"(SELECT u.k AS v, b.k AS h, n.k, u.q * b.q * n.q AS x FROM {node} {above} {before})")
    STEPS[f"placed{suffix}"] = f"{q} nodes", f"SELECT p.*, n.chrom, n.bin FROM {q} p JOIN nodes n ON n.chunk_id = p.chunk_id AND n.i = p.i AND n.t = p.t"
    _again("emission", suffix, q=f"placed{suffix}")
    _again("ll", suffix, emit=f"emission{suffix}")
    return {n: f"{n}{suffix}" for n in ("gam", "alp", "bet", "the", "ll")}


def _energy(q: str, own: str, ll: str, before: str, number: int) -> str:
    return f"""SELECT CAST({number} AS INT) AS iter, CAST(2 AS INT) AS sweeps, (SELECT round(max(abs(a.q - b.q)), 6) FROM {q} a JOIN {before} b USING (chunk_id, i, t, k)) AS change,
(SELECT round(sum(n.q * (ln(n.q) - own - ll)), 6) FROM {q} n JOIN {own} USING (chunk_id, i, t, k) JOIN {ll} USING (chunk_id, i, t, k)) AS energy"""


_sweep("_1", "jac")
_again("own", "_2", q="jac_1")
_NEXT = _estimate("_3", "jac_1")
_sweep("_4", "jac_1", **_NEXT)
_sweep("_5", "jac_4", **_NEXT)
_again("own", "_6", q="jac_5", **_NEXT)
RECURSIVE = {"leaff", "leafb", "fwd", "fwdg", "bwd", "vit", "back", "joint"}


def query(select: str, *steps: str) -> str:
    """select behind the steps that it names and all that these need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in STEPS[name][0].split():
            add(n)
        if name not in order:
            order.append(name)

    for s in steps:
        add(s)
    parts = [f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({STEPS[n][1]})" for n in order]
    return f"WITH {'RECURSIVE ' if RECURSIVE & set(order) else ''}" + ",\n".join(parts) + "\n" + select


R = "round({}, 6)".format
ORACLES = {
    "a1_reads": query("SELECT * FROM reads", "reads"),
    "a2_samples": query("""SELECT s.species, m.mark, CAST(count(DISTINCT r.rep) AS BIGINT) AS reps, count(r.rep) AS n FROM species_dim s CROSS JOIN mark_dim m
LEFT JOIN reads r ON r.species = s.species AND r.mark = m.mark GROUP BY s.species, m.mark""", "reads", "species_dim", "mark_dim"),
    "a5_params_roundtrip": query(f"SELECT 'emit' AS name, k, l, {R('e')} AS value FROM emission", "emission"),
    "a3_observations_round_trip": query("SELECT i, l, chrom, bin FROM cells", "cells"),
    "a7_bed_round_trip": query(f"""SELECT chrom, bin * 2000 AS "start", (bin + 1) * 2000 AS "end", species || '.state' || k AS name, {R('q')} AS score, '+' AS strand, species, k AS state
FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, bin, i ORDER BY q DESC, k) AS o FROM q) x JOIN species_dim s ON s.i = x.i WHERE o = 1""", "q", "species_dim"),
    "a8_restrict": query("SELECT i, l, chrom, bin FROM cells WHERE bin < 100 AND i < 3", "cells"),
    "b1_qc_filter": query("SELECT species, mark, rep, chrom, pos, flag, mapq FROM good", "good"),
    "b2_pair_filter": query("SELECT species, mark, rep, chrom, pos, flag FROM good WHERE flag & 1 = 0 OR flag & 2 <> 0", "good"),
    "b3_chrom_select": query("SELECT chrom, length, bins, count(*) AS n FROM reads JOIN sizes USING (chrom) GROUP BY ALL", "reads", "sizes"),
    "b4_midpoint_bin": query("SELECT species, mark, rep, chrom, pos, flag, bin FROM kept", "kept"),
    "b5_clamp": query("SELECT chrom, max(bin) AS last_bin, count(*) FILTER (WHERE bin = bins - 1) AS n_last FROM kept JOIN sizes USING (chrom) GROUP BY chrom", "kept", "sizes"),
    "b6_wide_export": query("SELECT g.chrom, g.bin, " + ", ".join(f"CAST(coalesce(max(CASE WHEN i * 6 + l = {c} THEN 1 END), 0) AS INT) AS c{c}" for c in range(30)) + " FROM grid g LEFT JOIN cells c ON c.chrom = g.chrom AND c.bin = g.bin GROUP BY g.chrom, g.bin", "grid", "cells"),
    "c1_histogram": query("SELECT species, mark, rep, chrom, bin, count(*) AS n FROM kept GROUP BY ALL", "kept"),
    "c2_pool": query("SELECT * FROM counts", "counts"),
    "c3_rate": query(f"SELECT species, mark, total, total_bins, {R('rate')} AS rate FROM rates", "rates"),
    "c4_calls": query("SELECT * FROM calls", "calls"),
    "c5_diagnostics": query(f"SELECT species, mark, most, CAST(n AS INT) AS n, {_SF.format(n='n')} < CAST(0.1 AS DOUBLE) AS present FROM (SELECT r.species, r.mark, rate, most, unnest(range(0, 20)) AS n FROM rates r JOIN (SELECT species, mark, max(n) AS most FROM counts GROUP BY ALL) m ON m.species = r.species AND m.mark = r.mark)", "rates", "counts"),
    "c6_assemble": query("SELECT i, l, chrom, bin FROM cells", "cells"),
    "c7_mark_avail": query("SELECT i, l FROM avail", "avail"),
    "d1_density": query("SELECT * FROM density", "density"),
    "d3_smooth": query(f"SELECT chrom, bin, {R('s')} AS s FROM smooth", "smooth"),
    "d3_smooth_blocks": query(f"SELECT chrom, bin, {R('s')} AS s FROM smooth", "smooth"),
    "d4_runs": query("SELECT * FROM runs", "runs"),
    "d5_min_size": query("""SELECT * FROM runs WHERE "end" - "start" >= 5""", "runs"),
    "d6_chunks": query("SELECT CAST(chunk_id AS BIGINT) AS chunk_id, chrom, number, \"start\", \"end\" FROM chunks", "chunks"),
    "d7_cut": query("SELECT CAST(chunk_id AS BIGINT) AS chunk_id, chrom, bin, i, l, t FROM cut", "cut"),
    "d8_coverage": query(f"""SELECT (SELECT count(*) FROM chunks) AS regions, CAST((SELECT sum("end" - "start") FROM chunks) AS BIGINT) AS covered_bins, CAST((SELECT sum("end" - "start") FROM runs) AS BIGINT) AS kept_bins,
CAST((SELECT sum(bins) FROM sizes) AS BIGINT) AS total_bins, {R('(SELECT sum("end" - "start") FROM chunks) / CAST((SELECT sum(bins) FROM sizes) AS DOUBLE)')} AS ratio""", "chunks", "runs", "sizes"),
    "d9_size_hist": query("""SELECT CAST(CASE WHEN high = low THEN 0 ELSE least(floor((size - low) / CAST(high - low AS DOUBLE) * 100), 99) END AS INT) AS bar, count(*) AS n
FROM (SELECT "end" - "start" AS size, min("end" - "start") OVER () AS low, max("end" - "start") OVER () AS high FROM chunks) GROUP BY ALL""", "chunks"),
    "e1_tree": query("""SELECT s.i, s.species, CASE WHEN p.i <> s.i THEN p.i END AS parent, p.i IS NULL OR p.i = s.i AS is_root FROM species_dim s
LEFT JOIN (VALUES ('AFRICA', 'AFRICA'), ('AMERICA', 'AFRICA'), ('ASIA', 'AFRICA'), ('EUROPE', 'ASIA'), ('MIDDLE EAST', 'ASIA')) v(species, parent) ON v.species = s.species
LEFT JOIN species_dim p ON p.species = v.parent""", "species_dim"),
    "e2_normalize": query(f"""SELECT 'alpha' AS name, h, k, {R('n / CAST(sum(n) OVER (PARTITION BY h) AS DOUBLE)')} AS value FROM (SELECT h, k, count(*) AS n FROM
(SELECT m AS k, lag(m) OVER (PARTITION BY chunk_id, i ORDER BY t) AS h FROM (SELECT chunk_id, i, t, k AS m FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, bin, i ORDER BY q DESC, k) AS o FROM q) WHERE o = 1)) WHERE h IS NOT NULL GROUP BY ALL)""", "q"),
    "e3_min_distance": query(f"SELECT id, {R('d')} AS distance, CAST(k AS INT) AS nearest FROM near WHERE o = 1", "near"),
    "e3_spread_centres": query(f"""SELECT CAST(k AS INT) AS k, id, n AS weight, CAST(unnest(range(0, len(x))) AS INT) AS l, {R('unnest(x)')} AS value
FROM (SELECT 0 AS k, * FROM pick0 UNION ALL SELECT 1, * FROM pick1 UNION ALL SELECT 2, * FROM pick2)""", "pick0", "pick1", "pick2"),
    "e4_start_variance": query(f"""SELECT k, CAST(l AS INT) AS l, {R("greatest(var_pop(value) + CAST(1e-6 AS DOUBLE), CAST(0.1 AS DOUBLE))")} AS variance FROM (SELECT k, unnest(range(0, len(x))) AS l, unnest(x) AS value FROM
(SELECT v.id, v.x, CAST(c.k AS INT) AS k, row_number() OVER (PARTITION BY v.id ORDER BY {_L1}, c.k) AS o FROM vec v, (SELECT 0 AS k, x FROM pick0 UNION ALL SELECT 1, x FROM pick1 UNION ALL SELECT 2, x FROM pick2) c) WHERE o = 1) GROUP BY k, l""", "vec", "pick0", "pick1", "pick2"),
    "e4_cluster_variance": query(f"""SELECT CAST(k AS INT) AS k, CAST(l AS INT) AS l, {R("greatest(var_pop(v) + CAST(1e-6 AS DOUBLE), CAST(0.1 AS DOUBLE))")} AS variance FROM (SELECT n.k, unnest(range(0, len(v.x))) AS l, unnest(v.x) AS v FROM near n JOIN vec v ON v.id = n.id WHERE o = 1) GROUP BY k, l""", "near", "vec"),
    "e5_bernoulli_ll": query(f"SELECT chrom, bin, i, k, {R('ll')} AS ll FROM ll", "ll"),
    "e6_gaussian_ll": query(f"""SELECT a.id, CAST(c.id AS INT) AS k, {R("-CAST(0.5 AS DOUBLE) * list_sum(list_transform(range(1, len(a.x) + 1), lambda j: ln(2 * pi() * (j * CAST(0.25 AS DOUBLE))) + (a.x[j] - c.x[j]) * (a.x[j] - c.x[j]) / (j * CAST(0.25 AS DOUBLE))))")} AS ll FROM vec a, vec c WHERE c.id IN (0, 1, 2)""", "vec"),
    "e7_emission_normalize": query(f"SELECT k, l, {R('e')} AS e FROM emission", "emission"),
    "f2_jacobi": query(f"SELECT CAST(chunk_id AS BIGINT) AS chunk_id, i, t, k, {R('q')} AS q FROM jac", "jac"),
    "f3_mean_field_stats": query(f"""SELECT 'gamma' AS name, CAST(k AS VARCHAR) AS idx, {R('sum(q)')} AS value FROM q JOIN tree USING (i) WHERE parent IS NULL AND t = 0 GROUP BY k
UNION ALL SELECT 'alpha', b.k || ',' || n.k, {R('sum(b.q * n.q)')} FROM q n JOIN tree USING (i) JOIN q b ON b.chunk_id = n.chunk_id AND b.i = n.i AND b.t = n.t - 1 WHERE parent IS NULL GROUP BY b.k, n.k
UNION ALL SELECT 'beta', u.k || ',' || n.k, {R('sum(u.q * n.q)')} FROM q n JOIN tree USING (i) JOIN q u ON u.chunk_id = n.chunk_id AND u.i = parent AND u.t = n.t WHERE n.t = 0 GROUP BY u.k, n.k
UNION ALL SELECT 'theta', u.k || ',' || b.k || ',' || n.k, {R('sum(u.q * b.q * n.q)')} FROM q n JOIN tree USING (i) JOIN q u ON u.chunk_id = n.chunk_id AND u.i = parent AND u.t = n.t
JOIN q b ON b.chunk_id = n.chunk_id AND b.i = n.i AND b.t = n.t - 1 GROUP BY u.k, b.k, n.k""", "q", "tree"),
    "f4_mean_field_energy": query(f"SELECT CAST(chunk_id AS BIGINT) AS chunk_id, {R('sum(q * (ln(q) - own - ll))')} AS energy FROM q JOIN own USING (chunk_id, i, t, k) JOIN ll USING (chunk_id, i, t, k) GROUP BY chunk_id", "q", "own", "ll"),
    "f19_em_relational": query(_energy("jac_1", "own_2", "ll", "jac", 0) + " UNION ALL " + _energy("jac_5", "own_6", "ll_3", "jac_4", 1), "jac", "jac_1", "own_2", "ll", "jac_4", "jac_5", "own_6", "ll_3"),
    "a6_posteriors_by_level": query(f"""SELECT CAST(0 AS INT) AS iter, chrom, bin, i, k, {R('q')} AS q FROM q UNION ALL
SELECT CAST(1 AS INT), n.chrom, n.bin, n.i, k, {R('q')} FROM jac JOIN nodes n USING (chunk_id, i, t)""", "q", "jac", "nodes"),
    "f5_convergence": query(f"SELECT {R('max(abs(q.q - jac.q))')} AS change, max(abs(q.q - jac.q)) < CAST(1e-3 AS DOUBLE) AS converged FROM q JOIN jac USING (chunk_id, i, t, k)", "q", "jac"),
    "f11_independent": query(f"SELECT CAST(chunk_id AS BIGINT) AS chunk_id, f.i, f.t, {R('a0 * b0 / (a0 * b0 + a1 * b1)')} AS q0 FROM fwd f JOIN bwd b USING (chunk_id, i, t)", "fwd", "bwd"),
    "f11_independent_blocks": query(f"SELECT CAST(chunk_id AS BIGINT) AS chunk_id, f.i, f.t, {R('a0 * b0 / (a0 * b0 + a1 * b1)')} AS q0 FROM fwd f JOIN bwd b USING (chunk_id, i, t)", "fwd", "bwd"),
    "f6_forward_likelihood": query(f"SELECT CAST(chunk_id AS BIGINT) AS chunk_id, {R('sum(lg)')} AS loglik FROM fwd WHERE t = n - 1 GROUP BY chunk_id", "fwd"),
    "f11_independent_gaussian": query(f"SELECT CAST(chunk_id AS BIGINT) AS chunk_id, {R('sum(lg)')} AS loglik FROM fwdg WHERE t = n - 1 GROUP BY chunk_id", "fwdg"),
    "f12_clique_pair": query(f"SELECT CAST(chunk_id AS BIGINT) AS chunk_id, {R('lg')} AS loglik FROM joint WHERE t = n - 1", "joint"),
    "f17_gaussian_m": query(f"""SELECT CAST(k AS INT) AS k, CAST(l AS INT) AS l, {R('sum(w * v) / sum(w)')} AS mean, {R("greatest(sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) * (sum(w * v) / sum(w)), 0) + CAST(1e-6 AS DOUBLE)")} AS variance
FROM (SELECT id, unnest(range(0, len(x))) AS l, unnest(x) AS v FROM vec) JOIN (SELECT id, k, w / sum(w) OVER (PARTITION BY id) AS w FROM (SELECT id, k, CAST(1 + (id * 3 + k * 7) % 11 AS DOUBLE) AS w FROM vec, st)) USING (id) GROUP BY k, l""", "vec", "st"),
    "f18_viterbi_chain": query("SELECT CAST(chunk_id AS BIGINT) AS chunk_id, i, t, CAST(state AS INT) AS state FROM back", "back"),
    "f18_viterbi_blocks": query("SELECT CAST(chunk_id AS BIGINT) AS chunk_id, i, t, CAST(state AS INT) AS state FROM back", "back"),
    "f7_leaf_posterior": query(f"""SELECT CAST(chunk_id AS BIGINT) AS chunk_id, t, CAST(unnest([0, 1, 2]) AS INT) AS k, unnest(list_transform([1, 2, 3], lambda k: round(a[k] * b[k] / (a[1] * b[1] + a[2] * b[2] + a[3] * b[3]), 6))) AS q
FROM leaff JOIN leafb USING (chunk_id, t)""", "leaff", "leafb"),
    "f9_leaf_energy": query(f"SELECT CAST(chunk_id AS BIGINT) AS chunk_id, {R('lg')} AS value FROM leaff WHERE t = n - 1", "leaff"),
    "g7_trajectory": query(f"""SELECT run_id, CAST(0 AS INT) AS iter, CAST(row_number() OVER (ORDER BY run_id) - 1 AS INT) AS step, {R('gain')} AS gain FROM (SELECT 'a' AS run_id, sum(lg) AS gain FROM fwd WHERE t = n - 1
UNION ALL SELECT 'b', sum(lg) FROM fwdg WHERE t = n - 1)""", "fwd", "fwdg"),
    "g2_bed_of_paths": query("""SELECT chrom, bin * 2000 AS "start", (bin + 1) * 2000 AS "end", species || '.state' || state AS name, CAST(1 AS DOUBLE) AS score, '+' AS strand, species, CAST(state AS INT) AS state
FROM back b JOIN nodes n ON n.chunk_id = b.chunk_id AND n.i = b.i AND n.t = b.t JOIN species_dim s ON s.i = b.i""", "back", "nodes", "species_dim"),
    "a4_glob_round_trip": query("SELECT i, l, chrom, bin FROM cells", "cells"),
    "w_convert_split": query("SELECT CAST(chunk_id AS BIGINT) AS chunk_id, chrom, bin, i, l, t FROM cut", "cut"),
    "g1_map": query("SELECT chrom, bin, i, k AS state FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, bin, i ORDER BY q DESC, k) AS o FROM q) WHERE o = 1", "q"),
    "g2_bed": query(f"""SELECT chrom, bin * 2000 AS "start", (bin + 1) * 2000 AS "end", species || '.state' || k AS name, {R('q')} AS score, '+' AS strand, species, k AS state
FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, bin, i ORDER BY q DESC, k) AS o FROM q) x JOIN species_dim s ON s.i = x.i WHERE o = 1""", "q", "species_dim"),
    "g3_bed_probabilities": query(f"""SELECT chrom, bin * 2000 AS "start", (bin + 1) * 2000 AS "end", species || '.state' || k AS name, {R('q')} AS score, '+' AS strand, species, k AS state FROM q JOIN species_dim s ON s.i = q.i""", "q", "species_dim"),
    "g4_stitch": query(f"SELECT chrom, bin, i, k, {R('q')} AS q FROM q", "q"),
    "g5_mark_load": query(f"SELECT n.chrom, n.bin, n.i, {R('count(c.l) / CAST(6 AS DOUBLE)')} AS load FROM nodes n LEFT JOIN cells c ON c.chrom = n.chrom AND c.bin = n.bin AND c.i = n.i GROUP BY n.chrom, n.bin, n.i", "nodes", "cells"),
    "g6_parameter_report": query("SELECT k, " + ", ".join(f"CAST(round(max(CASE WHEN l = {l} THEN e END) * 100) AS BIGINT) AS mark{l}" for l in range(6)) + " FROM emission GROUP BY k", "emission"),
    "g6_theta_slice": query('SELECT h AS "from", ' + ", ".join(R(f"max(CASE WHEN k = {k} THEN p END)") + f" AS state{k}" for k in range(3)) + """ FROM (SELECT h, k, w / sum(w) OVER (PARTITION BY h) AS p FROM
(SELECT b.k AS h, n.k, sum(u.q * b.q * n.q) AS w FROM q n JOIN tree USING (i) JOIN q u ON u.chunk_id = n.chunk_id AND u.i = parent AND u.t = n.t
JOIN q b ON b.chunk_id = n.chunk_id AND b.i = n.i AND b.t = n.t - 1 WHERE u.k = 0 GROUP BY b.k, n.k)) GROUP BY h""", "q", "tree"),
    "h1_trim": query("""SELECT chrom, min(bin) AS "start", max(bin) + 1 AS "end" FROM calls GROUP BY chrom""", "calls"),
    "h2_asinh": query(f"SELECT species, mark, chrom, bin, {R('value')} AS value FROM signal", "signal"),
    "h3_smooth_signal": query(f"SELECT v.species, v.mark, v.chrom, v.bin + x AS bin, {R('round(sum(value * k), 9)')} AS s FROM signal v, kern3 JOIN sizes z ON z.chrom = v.chrom WHERE v.bin + x >= 0 AND v.bin + x < bins GROUP BY v.species, v.mark, v.chrom, v.bin + x", "signal", "kern3", "sizes"),
    "h4_gradient": query(f"""SELECT species, mark, chrom, bin, {R('g')} AS g, {R('CASE WHEN lag(g) OVER w IS NOT NULL AND lead(g) OVER w IS NOT NULL THEN (lead(g) OVER w - lag(g) OVER w) / 2 ELSE coalesce(lead(g) OVER w - g, g - lag(g) OVER w, 0) END')} AS gg FROM
(SELECT *, CASE WHEN lag(value) OVER w IS NOT NULL AND lead(value) OVER w IS NOT NULL THEN (lead(value) OVER w - lag(value) OVER w) / 2 ELSE coalesce(lead(value) OVER w - value, value - lag(value) OVER w, 0) END AS g
FROM dense WINDOW w AS (PARTITION BY species, mark, chrom ORDER BY bin)) WINDOW w AS (PARTITION BY species, mark, chrom ORDER BY bin)""", "dense"),
    "h5_raw_regions": query("""SELECT chrom, min(bin) AS "start", max(bin) + 1 AS "end" FROM (SELECT chrom, bin, bin - row_number() OVER (PARTITION BY chrom ORDER BY bin) AS island
FROM (SELECT chrom, bin, round(sum(value), 9) AS s FROM signal GROUP BY ALL) WHERE s >= CAST(200 AS DOUBLE)) GROUP BY chrom, island HAVING max(bin) + 1 - min(bin) >= 5""", "signal"),
}
