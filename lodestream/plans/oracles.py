"""DuckDB SQL with the rows of each query."""

from __future__ import annotations

from ..operators.similarity import minhash_params
from .registry import BLOOM, EDGE, FM, PAIR_SHARE, PATH_EDGE, SET_SHARE, SPLIT_EDGE, TICK

SALES = "sales AS (SELECT l_orderkey, l_partkey, l_quantity, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey)"
PAIRS = "basket_items AS (SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM sales), n_baskets AS (SELECT count(DISTINCT b) AS n FROM basket_items)"


def itemsets(share: float, shown: str = "length >= 1", source: str = f"{SALES}, {PAIRS}") -> str:
    """Counts of all sets of frequent items of each basket, of any length."""
    return f"""WITH RECURSIVE {source}, least AS (SELECT {share} * n AS support FROM n_baskets),
    often AS (SELECT i FROM basket_items GROUP BY i HAVING count(*) >= (SELECT support FROM least)),
    kept AS (SELECT b, i FROM basket_items WHERE i IN (SELECT i FROM often)),
    sets(b, length, itemset, last) AS (SELECT b, 1, i, i FROM kept UNION ALL SELECT s.b, s.length + 1, s.itemset || '|' || k.i, k.i FROM sets s JOIN kept k ON k.b = s.b AND k.i > s.last)
    SELECT length::INTEGER AS length, itemset, count(*) AS support FROM sets WHERE {shown} GROUP BY ALL HAVING count(*) >= (SELECT support FROM least)"""


MONTHS = """rows_ AS (SELECT strftime(o_orderdate, '%Y%m') || '-' || o_custkey AS b, p_type AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
big AS (SELECT b FROM rows_ GROUP BY b HAVING count(*) > 3), basket_items AS (SELECT DISTINCT b, i FROM rows_ WHERE b IN (SELECT b FROM big)), n_baskets AS (SELECT count(DISTINCT b) AS n FROM basket_items)"""

def graph(least: int) -> str:
    return f"""bought AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
kept AS (SELECT x.c AS src, y.c AS dst, count(*) AS weight FROM bought x JOIN bought y ON x.p = y.p AND x.c < y.c GROUP BY 1, 2 HAVING count(*) >= {least}),
e AS MATERIALIZED (SELECT src, dst FROM kept UNION ALL SELECT dst, src FROM kept)"""


def propagated(rounds: int, least: int = EDGE) -> str:
    steps = ["l0 AS (SELECT DISTINCT src AS id, src AS label FROM e)"]
    for i in range(rounds):
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT id, label FROM (SELECT dst AS id, label, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, label) AS r FROM e JOIN l{i} ON e.src = l{i}.id GROUP BY dst, label) WHERE r = 1)")
    return f"WITH {graph(least)}, {', '.join(steps)}"


PATHS = f"""WITH RECURSIVE {graph(PATH_EDGE)},
paths(s, t, d, sigma) USING KEY (s, t) AS (
  SELECT DISTINCT src, src, 0::BIGINT, 1::BIGINT FROM e
  UNION ALL
  SELECT p.s, e.dst, p.d + 1, CAST(sum(p.sigma) AS BIGINT) FROM paths p JOIN e ON e.src = p.t
  WHERE NOT EXISTS (SELECT 1 FROM recurring.paths q WHERE q.s = p.s AND q.t = e.dst)
  GROUP BY p.s, e.dst, p.d)"""

COMPONENTS = f"""WITH RECURSIVE {graph(EDGE)},
found(id, component) USING KEY (id) AS (
  SELECT DISTINCT src, src FROM e
  UNION ALL
  SELECT e.dst, min(f.component) FROM found f JOIN e ON e.src = f.id JOIN recurring.found r ON r.id = e.dst WHERE f.component < r.component GROUP BY e.dst)
SELECT id, component FROM found"""

#: Shares of paths flow back from the farthest vertices, a level a step.
BETWEENNESS = f"""{PATHS},
placed AS MATERIALIZED (SELECT s, t, d, sigma FROM paths),
flows(d, s, u, v, passed) AS (
  SELECT w.d, w.s, e.src, w.t, b.sigma / CAST(w.sigma AS DOUBLE) FROM placed w JOIN e ON e.dst = w.t JOIN placed b ON b.s = w.s AND b.t = e.src AND b.d = w.d - 1 WHERE w.d = (SELECT max(d) FROM placed)
  UNION ALL
  SELECT w.d, w.s, e.src, w.t, (1 + coalesce(g.passed, 0)) * b.sigma / CAST(w.sigma AS DOUBLE)
  FROM placed w JOIN e ON e.dst = w.t JOIN placed b ON b.s = w.s AND b.t = e.src AND b.d = w.d - 1
  LEFT JOIN (SELECT s, u, sum(passed) AS passed FROM flows GROUP BY s, u) g ON g.s = w.s AND g.u = w.t
  WHERE w.d = (SELECT min(d) - 1 FROM flows) AND w.d > 0)
SELECT least(u, v) AS src, greatest(u, v) AS dst, round(sum(passed) / 2, 5) AS betweenness FROM flows GROUP BY 1, 2"""

SETS_USERS = "sets AS (SELECT DISTINCT user_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS element FROM events WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL)"
SETS_CUSTOMERS = "sets AS (SELECT DISTINCT o_custkey AS id, l_partkey AS element FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def jaccard(sets: str, least: float, candidates: str = "") -> str:
    limit = " JOIN cands USING (id_1, id_2)" if candidates else ""
    return f"""WITH {sets}{candidates}, sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
    met AS (SELECT x.id AS id_1, y.id AS id_2, count(*) AS both_ FROM sets x JOIN sets y ON x.element = y.element AND x.id < y.id GROUP BY 1, 2)
    SELECT id_1, id_2, round(both_ / CAST(a.n + b.n - both_ AS DOUBLE), 6) AS similarity FROM met{limit} JOIN sizes a ON a.id = id_1 JOIN sizes b ON b.id = id_2
    WHERE both_ / CAST(a.n + b.n - both_ AS DOUBLE) >= {least}"""


_MH = ", ".join(f"({i}, {a}, {b}, {p})" for i, (a, b, p) in enumerate(minhash_params(30)))
SIGNATURES = f""", numbers AS (SELECT element, row_number() OVER (ORDER BY element) - 1 AS number FROM (SELECT DISTINCT element FROM sets)),
sig AS (SELECT id, nth, min((a * number + b) % p % (SELECT count(*) FROM numbers)) AS value FROM sets JOIN numbers USING (element), (VALUES {_MH}) f(nth, a, b, p) GROUP BY id, nth)"""
CANDS = SIGNATURES + ", cands AS (SELECT DISTINCT x.id AS id_1, y.id AS id_2 FROM sig x JOIN sig y ON x.nth = y.nth AND x.value = y.value AND x.id < y.id WHERE x.nth % 2 = 0)"

RATED = f"""WITH {SALES}, rated AS (SELECT l_orderkey, o_custkey AS u, p_brand AS i, 1 + floor((l_quantity - 1) / 10) AS r FROM sales JOIN orders ON l_orderkey = o_orderkey),
train AS (SELECT u, i, avg(r) AS r FROM rated WHERE l_orderkey % 10 <> 0 GROUP BY u, i), test AS (SELECT DISTINCT u, i FROM rated WHERE l_orderkey % 10 = 0),
means AS (SELECT i, avg(r) AS mean, count(*) AS n FROM train GROUP BY i)"""
PEARSON = """, pearson AS (SELECT a.i AS a, b.i AS b, CASE WHEN stddev_pop(a.r) * stddev_pop(b.r) > 1e-12 THEN covar_pop(a.r, b.r) / (stddev_pop(a.r) * stddev_pop(b.r)) ELSE 0 END AS w, count(*) AS n
FROM train a JOIN train b ON a.u = b.u AND a.i <= b.i GROUP BY 1, 2)"""
CF = (
    RATED
    + PEARSON
    + """, near AS (SELECT t.u, t.i, x.r, coalesce(w, 0) AS w, pow(abs(coalesce(w, 0)), 2.5) AS s FROM test t JOIN train x ON t.u = x.u LEFT JOIN pearson ON a = least(t.i, x.i) AND b = greatest(t.i, x.i)),
sums AS (SELECT u, i, count(*) AS n, sum(CASE WHEN w > 0 THEN s * r ELSE 0 END) AS ur, sum(CASE WHEN w > 0 THEN s ELSE 0 END) AS us, sum(CASE WHEN w < 0 THEN s * (6 - r) ELSE 0 END) AS dr, sum(CASE WHEN w < 0 THEN s ELSE 0 END) AS ds FROM near GROUP BY u, i),
cf AS (SELECT t.u, t.i, coalesce(s.n, 0) AS n, CASE WHEN mean IS NULL THEN 3.84::DOUBLE WHEN us + CASE WHEN s.n < 10 THEN ds ELSE 0 END > 0
  THEN ((ur + CASE WHEN s.n < 10 THEN dr ELSE 0 END) / (us + CASE WHEN s.n < 10 THEN ds ELSE 0 END) + mean) / 2 ELSE mean END AS p
  FROM test t LEFT JOIN means m ON t.i = m.i LEFT JOIN sums s ON t.u = s.u AND t.i = s.i)"""
)

POINTS = "points AS (SELECT vec_id AS id, label AS cluster, unnest(range(1, len(embedding) + 1)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), sums AS (SELECT cluster, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM points GROUP BY cluster, dim)"

STREAM = f"WITH stream AS (SELECT event_id - (SELECT min(event_id) FROM events) + 1 AS seq, CAST(user_id AS VARCHAR) AS element FROM events), ticked AS (SELECT *, (seq - 1) // {TICK} AS tick FROM stream)"


def _params(family) -> str:
    return ", ".join(f"({i}, {a}, {b}, {p})" for i, (a, b, p) in enumerate(family.params))


def _hashed(family, source: str) -> str:
    """(element, f, h) of distinct elements: the bytes of a number's digits by Horner's rule."""
    codes = "list_transform(string_split(element, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"hashed AS (SELECT element, f, (a * (list_reduce({codes}, lambda acc, c: (acc * 256 + c) % p) % p) + b) % p % {family.size} AS h FROM (SELECT DISTINCT element FROM {source}), (VALUES {_params(family)}) t(f, a, b, p))"


TAIL = "CASE WHEN h = 0 THEN 1 ELSE length(bin(h)) - length(rtrim(bin(h), '0')) END"
FM_GROUPS = len(FM.params) // 3
ESTIMATES = f"""{STREAM}, {_hashed(FM, "stream")}, most AS (SELECT tick, f, max({TAIL}) AS m FROM (SELECT DISTINCT tick, element FROM ticked) JOIN hashed USING (element) GROUP BY tick, f),
grouped AS (SELECT tick, f // {FM_GROUPS} AS g, sum(pow(2, m)) / {FM_GROUPS} AS mean FROM most GROUP BY 1, 2),
truths AS (SELECT tick, count(DISTINCT element) AS truth FROM ticked GROUP BY tick),
estimates AS (SELECT tick, any_value(truth) AS truth, CAST(floor(median(mean)) AS BIGINT) AS estimate FROM grouped JOIN truths USING (tick) GROUP BY tick)"""
BY_ELEMENT = f"""{STREAM}, {_hashed(FM, "stream")}, powers AS (SELECT element, pow(2, max({TAIL})) AS w FROM hashed GROUP BY element),
placed AS (SELECT tick, (seq - 1) % {TICK} AS place, element, w FROM ticked JOIN powers USING (element)),
slices AS (SELECT tick, g, coalesce(sum(w) FILTER (place BETWEEN g * {FM_GROUPS} AND (g + 1) * {FM_GROUPS} - 2), 0) / {FM_GROUPS} AS mean FROM placed, range(3) t(g) GROUP BY tick, g)
SELECT tick, truth, CAST(floor(median(mean)) AS BIGINT) AS estimate FROM slices JOIN (SELECT tick, count(DISTINCT element) AS truth FROM ticked GROUP BY tick) USING (tick) GROUP BY tick, truth"""
BLOOMED = f"""{STREAM}, {_hashed(BLOOM, "stream")}, firsts AS (SELECT element, min(seq) AS seq FROM stream GROUP BY element),
bits AS (SELECT h, min(seq) AS set_at FROM hashed JOIN firsts USING (element) GROUP BY h),
said AS (SELECT element, seq, bool_and(set_at < seq) AS fp FROM hashed JOIN firsts USING (element) JOIN bits USING (h) GROUP BY element, seq),
by_tick AS (SELECT tick, count(fp) AS n, count(*) FILTER (fp) AS fp FROM (SELECT DISTINCT tick FROM ticked) LEFT JOIN (SELECT (seq - 1) // {TICK} AS tick, fp FROM said) USING (tick) GROUP BY tick)
SELECT tick, round(sum(fp) OVER w / CAST(nullif(sum(n) OVER w, 0) AS DOUBLE), 9) AS fpr FROM by_tick WINDOW w AS (ORDER BY tick)"""
PLACED = f"""{STREAM}, placed AS (SELECT seq, element, CASE WHEN seq <= 100 THEN seq - 1 ELSE CAST(floor(((seq % 1000003) * 69069 + 1) % 2147483648 / 2147483648.0::DOUBLE * 100) AS BIGINT) END AS slot FROM stream
WHERE seq <= 100 OR ((seq % 1000003) * 1103515245 + 12345) % 2147483648 / 2147483648.0::DOUBLE * seq < 100)"""
_SHOWN = (0, 20, 40, 60, 80)

ORACLES = {
    "baskets_orders": f"WITH {SALES} SELECT l_orderkey AS basket, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS items, count(DISTINCT p_brand) AS n FROM sales GROUP BY l_orderkey",
    "baskets_brands": f"WITH {SALES} SELECT p_brand AS basket, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS total FROM (SELECT DISTINCT p_brand, l_orderkey FROM sales) GROUP BY p_brand",
    "baskets_min_size": "SELECT month(o_orderdate) || '/1/' || right(CAST(year(o_orderdate) AS VARCHAR), 2) || '-' || o_custkey AS basket, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '|' ORDER BY CAST(l_partkey AS VARCHAR)) AS items, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) > 3",
    "frequent_pairs": itemsets(PAIR_SHARE, "length = 2"),
    "frequent_itemsets": itemsets(SET_SHARE),
    "son_itemsets": itemsets(PAIR_SHARE),
    "frequent_itemsets_months": itemsets(0.2, source=MONTHS),
    "co_purchase_graph": f"WITH {graph(EDGE)} SELECT src, dst, weight FROM kept",
    "label_propagation": f"{propagated(5)} SELECT id, label FROM l5",
    "label_communities": f"{propagated(5)} SELECT label, string_agg(CAST(id AS VARCHAR), '|' ORDER BY id) AS members, count(*) AS size FROM l5 GROUP BY label",
    "connected_components": COMPONENTS,
    "shortest_paths": f"{PATHS} SELECT s, t, d, sigma FROM paths",
    "edge_betweenness": BETWEENNESS,
    "jaccard_users": jaccard(SETS_USERS, 0.5),
    "jaccard_customers": jaccard(SETS_CUSTOMERS, 0.1),
    "minhash_signatures": f"WITH {SETS_USERS}{SIGNATURES} SELECT id, CAST(nth AS BIGINT) AS nth, value FROM sig",
    "lsh_users": jaccard(SETS_USERS, 0.5, CANDS),
    "item_means": f"{RATED} SELECT i AS item, round(mean, 6) AS mean, n FROM means",
    "item_pearson": f"{RATED}{PEARSON} SELECT a AS item_a, b AS item_b, round(w, 6) AS corr, n FROM pearson WHERE a < b",
    "item_cf": f'{CF} SELECT u AS "user", i AS item, round(p, 4) AS prediction, n FROM cf',
    "hybrid_item_mean": f'{CF} SELECT u AS "user", i AS item, round(CASE WHEN cf.n > 20 THEN 0.2::DOUBLE * p + (1 - 0.2::DOUBLE) * mean ELSE 0.01::DOUBLE * p + (1 - 0.01::DOUBLE) * mean END, 4) AS prediction FROM cf JOIN means USING (i)',
    "hybrid_tiered": f'{CF}, w AS (SELECT u, i, p, mean, CAST(CASE WHEN cf.n > 10 THEN 0.5 WHEN cf.n > 5 THEN 0.4 WHEN cf.n > 3 THEN 0.2 WHEN cf.n > 2 THEN 0.1 ELSE 0 END AS DOUBLE) AS s FROM cf JOIN means USING (i)) SELECT u AS "user", i AS item, round(s * p + (1 - s) * mean, 4) AS prediction FROM w',
    "assembled_features": f"""{RATED}, items AS (SELECT p_brand AS i, count(*) AS b_review_count, round(avg(p_retailprice), 4) AS b_price, round(avg(p_size), 4) AS b_size FROM part GROUP BY 1)
        SELECT i AS item, u AS "user", round(r, 6) AS rating, b_review_count, b_price, b_size, c_acctbal AS u_balance, {", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS u_{s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))}
        FROM train JOIN items USING (i) LEFT JOIN customer ON c_custkey = u""",
    "item_attributes": """SELECT s_suppkey AS item, CASE WHEN s_suppkey % 3 = 0 THEN 0.5::DOUBLE WHEN s_suppkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "Delivery", CASE WHEN s_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "InCredit",
        CASE WHEN s_nationkey < 12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "WiFi_free", CASE WHEN s_nationkey < 12 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS "WiFi_no" FROM supplier""",
    "cluster_summaries": f"WITH {POINTS} SELECT cluster, dim, n, round(s, 5) AS total, round(q, 5) AS squares FROM sums",
    "nearest_cluster": f"""WITH {POINTS}, far AS (SELECT p.id, c.cluster, sqrt(sum(pow(p.x - c.s / c.n, 2) / (c.q / c.n - pow(c.s / c.n, 2)))) AS distance FROM points p JOIN sums c ON p.dim = c.dim GROUP BY 1, 2),
        near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, cluster) AS r FROM far WHERE distance < 2 * sqrt((SELECT max(dim) FROM points))) SELECT id, cluster, round(distance, 5) AS distance FROM near WHERE r = 1""",
    "bloom_rates": BLOOMED,
    "distinct_estimates": f"{ESTIMATES} SELECT tick, truth, estimate FROM estimates",
    "distinct_estimates_by_element": BY_ELEMENT,
    "distinct_accuracy": f"{ESTIMATES} SELECT round(CAST(sum(truth) AS DOUBLE) / nullif(CAST(sum(estimate) AS DOUBLE), 0), 9) AS ratio FROM estimates",
    "reservoir": f"{PLACED} SELECT slot, max_by(element, seq) AS element, max(seq) AS seq FROM placed GROUP BY slot",
    "reservoir_snapshots": f"{PLACED}, ends AS (SELECT max(seq) AS seqnum FROM ticked GROUP BY tick HAVING max(seq) % 100 = 0), held AS (SELECT seqnum, slot, max_by(element, seq) AS element FROM ends JOIN placed ON seq <= seqnum GROUP BY 1, 2) SELECT seqnum, "
    + ", ".join(f"max(element) FILTER (slot = {s}) AS s{s}" for s in _SHOWN)
    + " FROM held WHERE slot IN (0, 20, 40, 60, 80) GROUP BY seqnum",
}

_LINE = "'(' || '''' || replace(itemset, '|', ''', ''') || ''')'"
ORACLES |= {
    "files_reviews": "SELECT CAST(o_custkey AS VARCHAR) AS user_id, count(*) AS n, count(DISTINCT l_partkey) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "files_ratings": "SELECT item, round(avg(r), 6) AS mean, count(*) AS n FROM (SELECT l_orderkey AS u, CAST(l_suppkey AS VARCHAR) AS item, avg(1 + l_quantity % 5) AS r FROM lineitem GROUP BY 1, 2) GROUP BY item",
    "files_transactions": ORACLES["baskets_min_size"],
    "files_businesses": "SELECT s_name AS item, CAST(s_nationkey AS BIGINT) AS b_review_count, round(s_acctbal / 1000, 1) AS b_star, CASE WHEN s_suppkey % 4 <> 0 THEN CASE WHEN s_nationkey < 12 THEN 'free' ELSE 'no' END END AS wifi FROM supplier",
    "files_users": 'SELECT c_name AS "user", c_custkey AS u_review_count, CAST(c_nationkey AS BIGINT) AS useful, 0::BIGINT AS funny, CASE WHEN c_custkey % 3 = 0 THEN 1::BIGINT ELSE 2 END AS cool, c_custkey % 7 AS fans, round(c_acctbal, 2) AS u_star FROM customer',
    "files_points": "SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4))), 4) AS total FROM embeddings",
    "files_elements": f"{STREAM} SELECT seq, element FROM stream",
    "report_itemsets": f"SELECT 'Frequent Itemsets' AS section, length, string_agg({_LINE}, ',' ORDER BY string_split(itemset, '|')) AS line FROM ({itemsets(PAIR_SHARE)}) GROUP BY length UNION ALL SELECT 'Frequent Itemsets', 0, 'Frequent Itemsets:'",
    "report_communities": f"SELECT '''' || members || '''' AS line FROM ({propagated(5, PATH_EDGE)} SELECT label, string_agg(CAST(id AS VARCHAR), ''', ''' ORDER BY id) AS members FROM l5 GROUP BY label)",
    "report_betweenness": f"SELECT '(''' || src || ''', ''' || dst || '''),' || betweenness AS line FROM ({BETWEENNESS.replace(graph(PATH_EDGE), graph(SPLIT_EDGE))})",
    "report_similar": ORACLES["jaccard_users"],
    "missing_values": f"{RATED} SELECT 0::BIGINT AS rating, 0::BIGINT AS b_price, count(*) FILTER (u % 7 = 0) AS u_balance FROM train",
    "stream_bloom_rates": ORACLES["bloom_rates"],
    "stream_distinct_estimates": f"{ESTIMATES} SELECT tick, estimate FROM estimates",
    "stream_reservoir": f"{PLACED} SELECT slot, max_by(element, seq) AS element FROM placed GROUP BY slot",
}

_SPLIT = BETWEENNESS.replace(graph(PATH_EDGE), graph(SPLIT_EDGE))
_NEAR = """{name} AS (SELECT id, cluster FROM (SELECT p.id, c.cluster, sqrt(sum(pow(p.x - c.s / c.n, 2) / (c.q / c.n - pow(c.s / c.n, 2)))) AS distance FROM points p JOIN sums c ON p.dim = c.dim WHERE c.cluster {which} GROUP BY 1, 2)
  WHERE distance < 2 * sqrt((SELECT max(dim) FROM points)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1)"""
_DISCARD, _COMPRESSED = _NEAR.format(name="near", which="< 5"), _NEAR.format(name="close", which=">= 5")
ORACLES |= {
    "betweenness_removal": f"""WITH RECURSIVE {graph(SPLIT_EDGE)}, scores AS MATERIALIZED ({_SPLIT}),
        gone AS (SELECT src, dst FROM scores WHERE betweenness = (SELECT max(betweenness) FROM scores)),
        kept_e AS MATERIALIZED (SELECT e.src, e.dst FROM e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.src = least(e.src, e.dst) AND g.dst = greatest(e.src, e.dst))),
        found(id, component) USING KEY (id) AS (
          SELECT DISTINCT src, src FROM e
          UNION ALL
          SELECT k.dst, min(f.component) FROM found f JOIN kept_e k ON k.src = f.id JOIN recurring.found r ON r.id = k.dst WHERE f.component < r.component GROUP BY k.dst)
        SELECT id, component FROM found""",
    "community_modularity": f"""{propagated(5, PATH_EDGE)}, degree AS (SELECT src AS id, count(*) AS k FROM e GROUP BY src), m AS (SELECT count(*) / 2.0::DOUBLE AS m FROM e),
        sums AS (SELECT label, sum(k) AS k, sum(k * k) AS kk FROM l5 JOIN degree USING (id) GROUP BY label),
        inside AS (SELECT count(*) AS n FROM kept JOIN l5 a ON a.id = src JOIN l5 b ON b.id = dst WHERE a.label = b.label)
        SELECT round(((SELECT n FROM inside) - (SELECT sum((k * k - kk) / 2.0::DOUBLE) FROM sums) / (2 * m)) / (2 * m), 6) AS modularity FROM m""",
    "bfr_assignment": f"WITH {POINTS}, {_DISCARD}, {_COMPRESSED} SELECT id, 'discard' AS part, cluster FROM near UNION ALL SELECT id, 'compression', cluster FROM close WHERE id NOT IN (SELECT id FROM near)",
    "bfr_update": f"""WITH {POINTS}, {_DISCARD}, every AS (SELECT cluster, dim, x FROM points WHERE cluster < 5 UNION ALL SELECT n.cluster, p.dim, p.x FROM near n JOIN points p USING (id))
        SELECT cluster, dim, count(*) AS n, round(sum(x), 5) AS total, round(sum(x * x), 5) AS squares FROM every GROUP BY cluster, dim""",
}
