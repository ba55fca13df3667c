"""SQL for the queries, in DuckDB's dialect, over the tables as they are."""

from __future__ import annotations


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')"


def _bm25(prefix: str, docs: str, asked: str, k: int, prune: str) -> str:
    """CTEs from docs (part, doc_id, ts) and asked (q_id, ts) to {prefix}rk (part, q_id, doc_id, score, rank <= k)."""
    return f"""
{prefix}d AS ({docs}), {prefix}q AS (SELECT q_id, unnest(ts) AS token FROM ({asked})),
{prefix}sz AS (SELECT part, count(*) AS n, avg(len(ts)) AS avgdl FROM {prefix}d GROUP BY part),
{prefix}po AS (SELECT part, doc_id, len(ts) AS dl, unnest(ts) AS token FROM {prefix}d),
{prefix}df AS (SELECT part, token, count(*) AS df FROM {prefix}po GROUP BY part, token),
{prefix}ix AS (SELECT part, token, doc_id, ln((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w
  FROM {prefix}po JOIN {prefix}df USING (part, token) JOIN {prefix}sz USING (part) WHERE {prune}),
{prefix}sc AS (SELECT part, q_id, doc_id, round(sum(w), 6) AS score FROM {prefix}q JOIN {prefix}ix USING (token) GROUP BY part, q_id, doc_id),
{prefix}all AS (SELECT *, row_number() OVER (PARTITION BY part, q_id ORDER BY score DESC, doc_id) AS rank FROM {prefix}sc),
{prefix}rk AS (SELECT * FROM {prefix}all WHERE rank <= {k})"""


EVENTS = ("click", "error", "purchase", "signup", "view")
_T = f"list_distinct({tokens('text')})"
_STEMS = "list_distinct(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}'), lambda t: t[1:5]))"
MAIN = _bm25("m", f"SELECT lang AS part, doc_id, {_T} AS ts FROM documents", f"SELECT item_id AS q_id, {_T} AS ts FROM benchmark", 5, "df <= 0.1 * n")
NAME = _bm25("n", f"SELECT lang AS part, doc_id, {_STEMS} AS ts FROM documents", f"SELECT item_id AS q_id, {_STEMS} AS ts FROM benchmark", 3, "df <= 0.1 * n")
POOL = MAIN + ",\npool AS (SELECT q_id, doc_id, part, score, rank, round(score / (score + 20), 6) AS p FROM mrk)"
TRUTH = f"""
tq AS (SELECT item_id AS q_id, len({_T}) AS size, unnest({_T}) AS token FROM benchmark),
td AS (SELECT doc_id, unnest({_T}) AS token FROM documents),
truth AS (SELECT q_id, doc_id, count(*) AS shared FROM tq JOIN td USING (token) GROUP BY q_id, doc_id, size HAVING count(*) >= 0.6 * size)"""
ACCEPT = POOL + ", acc AS (SELECT q_id, doc_id, p FROM pool WHERE p >= 0.4)"
LINKS = ACCEPT + ", links AS (SELECT q_id, doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, q_id) AS r FROM acc) WHERE r = 1)"
F05 = "CASE WHEN gt = 0 THEN CASE WHEN pred = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (0.25 * gt + pred) END"


def _owner(links: str) -> str:
    return f"""owner AS (SELECT item_id AS q_id, text, coalesce(gt, 0) AS gt, coalesce(pred, 0) AS pred, coalesce(tp, 0) AS tp FROM benchmark
  LEFT JOIN (SELECT q_id, count(*) AS gt FROM truth GROUP BY q_id) g ON item_id = g.q_id
  LEFT JOIN (SELECT q_id, count(*) AS pred, count(shared) AS tp FROM (SELECT l.q_id, l.doc_id, shared FROM {links} l LEFT JOIN truth USING (q_id, doc_id)) GROUP BY q_id) p ON item_id = p.q_id)"""


SUMMARY = f"""count(*) AS owners, round(avg({F05}), 6) AS macro_f05, sum(tp)::BIGINT AS tp, (sum(pred) - sum(tp))::BIGINT AS fp,
round(sum(tp) / greatest(sum(pred), 1), 6) AS precision, round(sum(tp) / greatest(sum(gt), 1), 6) AS recall"""
SCORED = LINKS + "," + TRUTH + "," + _owner("links")
HIT = POOL + "," + TRUTH + ", hits AS (SELECT pool.q_id, pool.doc_id, p, CASE WHEN shared IS NULL THEN 0 ELSE 1 END AS hit FROM pool LEFT JOIN truth USING (q_id, doc_id))"
_PT = tokens("name")
NAMES = f"""
nm AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name),
nt AS (SELECT id, name, {_PT} AS ts FROM nm),
nk AS (SELECT DISTINCT id, array_to_string(list_sort(list_distinct(list_filter(ts, lambda y: y <> x))), ' ') AS key FROM (SELECT id, ts, unnest(ts) AS x FROM nt)),
sib AS (SELECT l.id AS a, r.id AS b, min(l.key) AS key FROM nk l JOIN nk r ON l.key = r.key AND l.id < r.id WHERE l.key <> '' GROUP BY l.id, r.id),
np AS (SELECT a, b, key, x.name AS name_a, y.name AS name_b, x.ts AS ta, y.ts AS tb FROM sib JOIN nt x ON a = x.id JOIN nt y ON b = y.id)"""
UNION = POOL + "," + NAME + """, un AS (SELECT coalesce(a.q_id, b.q_id) AS q_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.rank, 999) AS rank_a, coalesce(b.rank, 999) AS rank_b
  FROM mrk a FULL JOIN nrk b ON a.q_id = b.q_id AND a.doc_id = b.doc_id)"""


def _norm(kept: str) -> str:
    return rf"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '[^\p{{L}}\p{{N}}{kept}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: t <> 'null' AND t <> ''), ' ')"


def _only(x: str, y: str) -> str:
    return f"len(list_distinct(list_filter({x}, lambda t: NOT list_contains({y}, t))))"


def _jac(x: str, y: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 0.0 ELSE len(list_distinct(list_intersect({x}, {y}))) / len(list_distinct(list_concat({x}, {y}))) END"


_BUCKET = "CASE " + " ".join(f"WHEN n <= {m} THEN '{b}'" for m, b in ((1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (50, "11-50"), (100, "51-100"), (1000, "101-1000"))) + " ELSE '1000+' END"
_SHIFT = "1, 2, 3, 4, 5, 7, 9, 11, 13, 21"
_NUM = "list_transform(regexp_extract_all({}, '[0-9]+'), lambda r: CASE WHEN ltrim(r, '0') = '' THEN '0' ELSE ltrim(r, '0') END)"
_INT = "substring({}, 1, 15)::BIGINT"
_GRAMS = "list_distinct(CASE WHEN length(p_name) >= 4 THEN list_transform(range(1, length(p_name) - 2), lambda i: substring(lower(p_name), i, 4)) ELSE [] END)"
_LEGAL = "'sarl', 'sas', 'sa', 'sasu', 'eurl', 'sci', 'snc', 'scop', 'scs', 'sca', 'gie', 'selarl', 'earl', 'ei', 'eirl', 'llc', 'inc', 'co', 'corp', 'corporation', 'company', 'ltd', 'limited', 'private', 'pvt', 'pc', 'plc', 'lp', 'llp', 'pllc'"

_STEP = "list_transform(range(1, len(d) + 2), lambda i: coalesce(d[i], 0) * (1 - p) + coalesce(d[i - 1], 0) * p)"
#: Counts of true matches among the k best (pre) and the others (suf) of each owner, then the expected F0.5 of each k.
EXPECTED = f"""s AS (SELECT q_id, p, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, doc_id) AS n FROM pool), z AS (SELECT q_id, max(n) AS m FROM s GROUP BY q_id),
pre AS (SELECT q_id, 0::BIGINT AS k, [1.0::DOUBLE] AS d FROM z UNION ALL SELECT pre.q_id, k + 1, {_STEP} FROM pre JOIN s ON s.q_id = pre.q_id AND s.n = k + 1),
suf AS (SELECT q_id, m AS k, [1.0::DOUBLE] AS d FROM z UNION ALL SELECT suf.q_id, k - 1, {_STEP} FROM suf JOIN s ON s.q_id = suf.q_id AND s.n = k),
v AS (SELECT q_id, k, x.d[1] * y.d[1] * CASE WHEN k = 0 THEN 1 ELSE 0 END AS none, x.d AS a, y.d AS b FROM pre x JOIN suf y USING (q_id, k)),
w AS (SELECT q_id, k, CASE WHEN k = 0 THEN any_value(none) ELSE sum(a[i + 1] * b[j + 1] * 1.25 * i / (0.25 * (i + j) + k)) END AS f FROM (SELECT *, unnest(range(0, len(b))) AS j FROM (SELECT *, unnest(range(0, len(a))) AS i FROM v)) GROUP BY q_id, k)"""

ORACLES: dict[str, str] = {
    "normalized_text": f"SELECT conv_id, turn, {_norm('')} AS norm, {_norm(chr(92) + 'p{M}')} AS norm_marks FROM conversations",
    "token_df": f"SELECT part, token, count(*) AS df FROM (SELECT lang AS part, unnest({_T}) AS token FROM documents) GROUP BY part, token",
    "idf_table": f"SELECT token, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM (SELECT token, count(*) AS df FROM (SELECT unnest({_T}) AS token FROM documents) GROUP BY token), (SELECT count(*) AS n FROM documents)",
    "name_freq_profile": "WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) SELECT count(*) AS n_distinct, sum(n)::BIGINT AS n_rows, round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*), 6) AS share_unique, max(n) AS max_n, (SELECT p_name FROM c ORDER BY n DESC, p_name DESC LIMIT 1) AS top_key, coalesce(sum(n) FILTER (n >= 2), 0)::BIGINT AS rows_ge2, coalesce(sum(n) FILTER (n >= 10), 0)::BIGINT AS rows_ge10, coalesce(sum(n) FILTER (n >= 100), 0)::BIGINT AS rows_ge100 FROM c",
    "freq_buckets": f"SELECT {_BUCKET} AS bucket, count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) GROUP BY 1",
    "grouping_profile": "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())",
    "exact_dup_groups": "SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "address_sharing_counts": "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY o_custkey",
    "crosstab_margins": "SELECT p_brand AS brand, p_type AS type, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)",
    "pivot_counts": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS n_{e}" for e in EVENTS) + " FROM events GROUP BY user_id",
    "rollup_match_coverage": f"WITH {TRUTH} SELECT lang AS part, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM truth)) AS n_hit FROM documents GROUP BY ROLLUP (lang)",
    "mutual_information": "WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem), g AS (SELECT least(floor((l_quantity - a) / (b - a) * 20), 19) AS x, least(floor((l_extendedprice - c) / (d - c) * 20), 19) AS y, count(*) AS n FROM lineitem, e GROUP BY 1, 2), h AS (SELECT n, sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny, sum(n) OVER ()::DOUBLE AS t FROM g) SELECT round(sum(n / t * log2(n * t / (nx * ny))), 6) AS bits FROM h",
    "link_count_distribution": "SELECT n, count(*) AS owners FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY n",
    "count_prior": "SELECT c_mktsegment, count(*) AS owners, round(avg(n), 6) AS mean_n, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS share_empty FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL) GROUP BY c_mktsegment",
    "vocabulary_tails": f"SELECT list_last(ts) AS tail, count(*) AS n FROM (SELECT {tokens('p_name')} AS ts FROM part) WHERE len(ts) > 0 GROUP BY 1 HAVING count(*) >= 5",
    "bm25_topk_lang": f"WITH {MAIN} SELECT part, q_id, doc_id, score, rank FROM mrk",
    "bm25_name_channel": f"WITH {NAME} SELECT part, q_id, doc_id, score, rank FROM nrk",
    "bm25_char_grams": "WITH " + _bm25("g", f"SELECT p_brand AS part, p_partkey AS doc_id, {_GRAMS} AS ts FROM part", f"SELECT min(p_partkey) AS q_id, {_GRAMS} AS ts FROM part GROUP BY p_name", 2, "df <= 5000") + " SELECT part, q_id, doc_id, score, rank FROM grk",
    "pool_union": f"WITH {UNION} SELECT * FROM un",
    "capped_union": f"WITH {POOL}, {NAME}, a AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS r FROM mrk), b AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS r FROM nrk), u AS (SELECT q_id, doc_id, min(pos) AS pos FROM (SELECT q_id, doc_id, r AS pos FROM a WHERE r <= 4 UNION ALL SELECT q_id, doc_id, 100 + r FROM b WHERE r <= 4) GROUP BY q_id, doc_id), v AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY pos, doc_id) AS place FROM u) SELECT * FROM v WHERE place <= 6",
    "reverse_bm25_top1": f"WITH {MAIN} SELECT part, doc_id, q_id, score FROM (SELECT *, row_number() OVER (PARTITION BY part, doc_id ORDER BY score DESC, q_id) AS r FROM msc) WHERE r = 1",
    "containment_owner_count": f"WITH {TRUTH} SELECT doc_id, count(*) AS owners, max(shared) AS max_shared FROM truth GROUP BY doc_id",
    "deletion_key_siblings": f"WITH {NAMES} SELECT a, b, key FROM sib",
    "dense_topk_cosine": "SELECT * FROM (SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.vec_id AS q_id, d.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0)) WHERE rank <= 5",
    "dense_lexical_union": "WITH s AS (SELECT q.vec_id AS q_id, d.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score, q.label = d.label AS same FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0), a AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS r FROM s), b AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY doc_id) AS r FROM s WHERE same) SELECT q_id, doc_id, coalesce(min(ra), 999) AS rank_a, coalesce(min(rb), 999) AS rank_b FROM (SELECT q_id, doc_id, r AS ra, NULL AS rb FROM a WHERE r <= 3 UNION ALL SELECT q_id, doc_id, NULL, r FROM b WHERE r <= 3) GROUP BY q_id, doc_id",
    "shared_token_idf_block": f"WITH {POOL}, {TRUTH}, w AS (SELECT token, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT token, count(*) AS df FROM td GROUP BY token), (SELECT count(*) AS n FROM documents)), qw AS (SELECT q_id, token, idf FROM tq JOIN w USING (token)), t AS (SELECT q_id, sum(idf) AS total FROM qw GROUP BY q_id), s AS (SELECT pool.q_id, pool.doc_id, sum(idf) AS s, avg(idf) AS a, max(idf) AS hi, min(idf) AS lo, count(*) AS n FROM pool JOIN qw ON pool.q_id = qw.q_id JOIN td ON td.doc_id = pool.doc_id AND td.token = qw.token GROUP BY pool.q_id, pool.doc_id) SELECT pool.q_id, pool.doc_id, round(coalesce(s, 0), 6) AS idf_sum, round(coalesce(a, 0), 6) AS idf_mean, round(coalesce(hi, 0), 6) AS idf_max, round(coalesce(lo, 0), 6) AS idf_min, round(coalesce(s, 0) / greatest(coalesce(total, 0), 1e-5), 6) AS idf_ratio, coalesce(n, 0) AS n_shared FROM pool LEFT JOIN s USING (q_id, doc_id) LEFT JOIN t USING (q_id)",
    "retrieval_provenance_block": f"WITH {UNION} SELECT q_id, doc_id, least(rank_a, 51) AS rank_a_capped, least(rank_b, 11) AS rank_b_capped, round(CASE WHEN rank_a <= 50 THEN (51 - rank_a) / 50 ELSE 0 END, 6) AS pct_a, round(CASE WHEN rank_b <= 10 THEN (11 - rank_b) / 10 ELSE 0 END, 6) AS pct_b, CASE WHEN rank_a < 999 AND rank_b < 999 THEN 1 ELSE 0 END AS both, round(ia + ib, 6) AS inv_sum, round(abs(ia - ib), 6) AS inv_diff FROM (SELECT *, CASE WHEN rank_a < 999 THEN 1 / rank_a ELSE 0 END AS ia, CASE WHEN rank_b < 999 THEN 1 / rank_b ELSE 0 END AS ib FROM un)",
    "name_similarity_block": f"WITH {NAMES} SELECT a, b, round(1 - levenshtein(name_a, name_b) / greatest(length(name_a), length(name_b)), 6) AS name_lev, round({_jac('ta', 'tb')}, 6) AS name_jaccard, round(len(list_intersect(list_distinct(ta), list_distinct(tb))) / least(len(list_distinct(ta)), len(list_distinct(tb))), 6) AS name_overlap, abs(length(name_a) - length(name_b)) AS len_diff, round(least(length(name_a), length(name_b)) / greatest(length(name_a), length(name_b)), 6) AS len_ratio FROM np",
    "number_block_basic": f"WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderpriority AS p, {_NUM.format('concat_ws(chr(32), o_orderkey, o_custkey, o_orderpriority)')} AS ns FROM orders), x AS (SELECT l.id AS a, r.id AS b, l.ns AS na, r.ns AS nb, list_reduce(l.ns, lambda acc, y: CASE WHEN length(y) > length(acc) THEN y ELSE acc END) AS own FROM o l JOIN o r ON l.c = r.c AND l.p = r.p AND l.id < r.id) SELECT a, b, len(na) AS n_left, len(nb) AS n_right, own AS longest, CASE WHEN list_contains(nb, own) THEN 3 WHEN len(list_filter(nb, lambda y: contains(y, own) OR contains(own, y))) > 0 THEN 4 ELSE 5 END AS status, round(ln(1 + list_min(list_transform(nb, lambda y: abs({_INT.format('y')} - {_INT.format('own')})))), 6) AS gap, list_min(list_transform(nb, lambda y: levenshtein(y, own))) AS edit, CASE WHEN len(list_filter(nb, lambda y: y <> own AND list_sort(string_split(y, '')) = list_sort(string_split(own, '')))) > 0 THEN 1 ELSE 0 END AS swapped, CASE WHEN len(list_filter(nb, lambda y: length(y) = length(own) AND abs({_INT.format('y')} - {_INT.format('own')}) BETWEEN 1 AND 50)) > 0 THEN 1 ELSE 0 END AS near, round({_jac('na', 'nb')}, 6) AS number_jaccard FROM x",
    "token_asymmetry_block": f"WITH {POOL}, x AS (SELECT pool.q_id, pool.doc_id, list_distinct({tokens('b.text')}) AS ta, list_distinct({tokens('d.text')}) AS tb FROM pool JOIN benchmark b ON item_id = pool.q_id JOIN documents d ON d.doc_id = pool.doc_id), y AS (SELECT *, {_only('ta', 'tb')} AS l, {_only('tb', 'ta')} AS r FROM x) SELECT q_id, doc_id, l AS only_left, r AS only_right, round(l / len(ta), 6) AS share_left, round(r / len(tb), 6) AS share_right FROM y",
    "one_token_edit_kind": f"WITH {NAMES}, u AS (SELECT a, b, token, sum(n) AS n FROM (SELECT a, b, unnest(ta) AS token, 1 AS n FROM np UNION ALL SELECT a, b, unnest(tb), -1 FROM np) GROUP BY a, b, token), s AS (SELECT a, b, sum(greatest(n, 0)) AS l, sum(greatest(-n, 0)) AS r FROM u GROUP BY a, b) SELECT a, b, CASE WHEN l = 0 AND r = 0 THEN 'equal' WHEN l = 1 AND r = 1 THEN 'sub' WHEN l = 0 AND r = 1 THEN 'add' WHEN l = 1 AND r = 0 THEN 'drop' ELSE 'other' END AS kind FROM s",
    "diff_token_block": f"WITH {NAMES}, f AS (SELECT token, round(ln(count(*)), 6) AS ldf FROM (SELECT unnest(list_distinct({tokens('p_name')})) AS token FROM part) GROUP BY token), x AS (SELECT a, b, list_min(list_filter(ta, lambda t: NOT list_contains(tb, t))) AS da, list_min(list_filter(tb, lambda t: NOT list_contains(ta, t))) AS db FROM np) SELECT a, b, da, db, u.ldf AS ldf_a, v.ldf AS ldf_b FROM x LEFT JOIN f u ON u.token = da LEFT JOIN f v ON v.token = db",
    "name_keys": f"SELECT p_partkey AS id, array_to_string(list_sort(list_filter({tokens('p_name')}, lambda t: t NOT IN ({_LEGAL}))), ' ') AS core, array_to_string(list_sort({tokens('p_name')}), ' ') AS multiset, array_to_string(list_transform({tokens('p_name')}, lambda t: t[1]), '') AS acronym, greatest(length(p_name) - 3, 0) AS n_grams FROM part",
    "competition_block": f"WITH {POOL}, b AS (SELECT q_id, doc_id, max(p) AS p FROM pool GROUP BY q_id, doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY p DESC, doc_id) AS pos, count(*) OVER (PARTITION BY q_id) AS k FROM b), s AS (SELECT *, max(p) OVER (PARTITION BY q_id) AS top, coalesce(max(CASE WHEN pos = 2 THEN p END) OVER (PARTITION BY q_id), 0) AS second FROM r) SELECT q_id, doc_id, p, pos, round(top, 6) AS top, round(second, 6) AS second, round(CASE WHEN k = 1 THEN 1 ELSE (k - pos) / (k - 1) END, 6) AS pct, round(p - second, 6) AS to_second, round(p - top, 6) AS to_top, " + ", ".join(f"count(*) FILTER (p > 0.{n}) OVER (PARTITION BY q_id) AS n{n}0" for n in "879") + ", round(stddev_pop(p) OVER (PARTITION BY q_id), 6) AS std, round(avg(p) OVER (PARTITION BY q_id), 6) AS mean FROM s",
    "runner_up_owner": f"WITH {POOL}, r AS (SELECT q_id, doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, q_id) AS pos FROM pool), s AS (SELECT *, max(CASE WHEN pos = 1 THEN p END) OVER (PARTITION BY doc_id) AS p1, max(CASE WHEN pos = 2 THEN p END) OVER (PARTITION BY doc_id) AS p2 FROM r) SELECT doc_id, q_id, p, coalesce(CASE WHEN pos = 1 THEN p2 ELSE p1 END, 0) AS rival FROM s",
    "structural_support": f"WITH {POOL} SELECT q_id, doc_id, part, count(*) OVER (PARTITION BY q_id, part) - 1 AS n_agree, count(*) OVER (PARTITION BY q_id) - count(*) OVER (PARTITION BY q_id, part) AS n_differ FROM pool",
    "normalised_mass": f"WITH {POOL} SELECT q_id, doc_id, p, round(p / greatest(1.0, sum(p) OVER (PARTITION BY doc_id)), 6) AS mass FROM pool",
    "group_topk": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "max_claimer": f"WITH {LINKS} SELECT * FROM links",
    "drop_all_contested": f"WITH {ACCEPT} SELECT q_id, doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM acc) WHERE n = 1",
    "margin_rule": f"WITH {POOL}, r AS (SELECT q_id, doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, q_id) AS n FROM pool) SELECT a.q_id, a.doc_id, a.p FROM r a LEFT JOIN r b ON a.doc_id = b.doc_id AND b.n = 2 WHERE a.n = 1 AND round(a.p - coalesce(b.p, 0), 6) >= 0.05",
    "soft_owner_posterior": f"WITH {POOL}, o AS (SELECT q_id, doc_id, p, p / (1 - p) AS o FROM pool) SELECT q_id, doc_id, p, round(o / (1 + sum(o) OVER (PARTITION BY doc_id)), 6) AS posterior FROM o",
    "no_match_gate": f"WITH {POOL} SELECT q_id, doc_id, p FROM (SELECT q_id, doc_id, p, max(p) OVER (PARTITION BY q_id) AS best FROM pool) WHERE best >= 0.6",
    "veto_keeps_last": f"WITH {LINKS} SELECT q_id, doc_id, p FROM (SELECT *, count(*) FILTER (p >= 0.6) OVER (PARTITION BY q_id) AS n FROM links) WHERE n = 0 OR p >= 0.6",
    "probability_blend": f"WITH {POOL}, {NAME}, b AS (SELECT q_id, doc_id, max(round(score / (score + 20), 6)) AS p FROM nrk GROUP BY q_id, doc_id) SELECT coalesce(pool.q_id, b.q_id) AS q_id, coalesce(pool.doc_id, b.doc_id) AS doc_id, round(0.7 * coalesce(pool.p, 0) + (1 - 0.7::DOUBLE) * coalesce(b.p, 0), 6) AS p FROM pool FULL JOIN b ON pool.q_id = b.q_id AND pool.doc_id = b.doc_id",
    "threshold_grid": f"WITH {HIT}, g AS (SELECT round(0.1 + 0.02 * i, 2)::DOUBLE AS th FROM range(0, 43) t(i)), pr AS (SELECT th, q_id, count(*) AS pred, sum(hit) AS tp FROM hits, g WHERE p >= th GROUP BY th, q_id), gt AS (SELECT q_id, count(*) AS gt FROM truth GROUP BY q_id), e AS (SELECT th, item_id, coalesce(gt, 0) AS gt, coalesce(pred, 0) AS pred, coalesce(tp, 0) AS tp FROM benchmark CROSS JOIN g LEFT JOIN gt ON gt.q_id = item_id LEFT JOIN pr USING (th, q_id)) SELECT th, round(avg({F05}), 6) AS macro_f05 FROM e GROUP BY th".replace("LEFT JOIN pr USING (th, q_id)", "LEFT JOIN pr ON pr.th = g.th AND pr.q_id = item_id").replace("SELECT th, item_id", "SELECT g.th AS th, item_id"),
    "macro_f05": f"WITH {SCORED} SELECT {SUMMARY} FROM owner",
    "slice_summary": f"WITH {SCORED} SELECT CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS slice, {SUMMARY} FROM owner GROUP BY 1",
    "recall_at_k": f"WITH {POOL}, {TRUTH} SELECT k, count(*) AS links, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM truth LEFT JOIN pool USING (q_id, doc_id), (SELECT unnest([1, 2, 3, 5]) AS k) GROUP BY k",
    "pool_oracle": f"WITH {POOL}, {TRUTH}, held AS (SELECT q_id, doc_id FROM pool JOIN truth USING (q_id, doc_id)), {_owner('held')} SELECT {SUMMARY} FROM owner",
    "pool_jaccard": f"WITH {UNION} SELECT q_id, count(*) FILTER (rank_a < 999) AS n_a, count(*) FILTER (rank_b < 999) AS n_b, round(count(*) FILTER (rank_a < 999 AND rank_b < 999) / count(*), 6) AS jaccard FROM un GROUP BY q_id",
    "loss_budget": f"WITH {SCORED} SELECT CASE WHEN gt = 0 AND pred = 0 THEN 'right empty' WHEN gt = 0 THEN 'false on empty' WHEN tp = 0 THEN 'all missed' WHEN pred > tp THEN 'some false' WHEN gt > tp THEN 'some missed' ELSE 'exact' END AS category, count(*) AS owners, round(sum(1 - {F05}), 6) AS loss FROM owner GROUP BY 1",
    "calibration_bins": f"WITH {HIT} SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(hit), 6) AS share FROM hits GROUP BY 1",
    "auc_rank": f"WITH {HIT}, r AS (SELECT hit, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS ar FROM hits) SELECT round((sum(ar) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2) / (sum(hit) * sum(1 - hit)), 6) AS auc FROM r",
    "contest_anatomy": f"WITH {POOL}, a AS (SELECT q_id, doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, q_id) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM pool WHERE p >= 0.3) SELECT x.doc_id, x.q_id AS winner, y.q_id AS loser, round(x.p - y.p, 6) AS lead FROM a x JOIN a y ON x.doc_id = y.doc_id AND x.r = 1 AND y.r = 2 WHERE x.n = 2",
    "unclaimed_near_match": f"WITH {LINKS} SELECT q_id, doc_id, p FROM pool WHERE p >= 0.4 AND doc_id NOT IN (SELECT doc_id FROM links WHERE p >= 0.6)",
    "set_change_classes": f"WITH {LINKS}, nw AS (SELECT q_id, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM pool WHERE p >= 0.5) WHERE n = 1), b AS (SELECT coalesce(o.q_id, n.q_id) AS q_id, CASE WHEN o.q_id IS NULL THEN 'added' WHEN n.q_id IS NULL THEN 'removed' ELSE 'kept' END AS change FROM links o FULL JOIN nw n ON o.q_id = n.q_id AND o.doc_id = n.doc_id) SELECT change, count(*) AS links, count(DISTINCT q_id) AS owners FROM b GROUP BY change",
    "mirror_census": f"WITH p AS (SELECT l.p_type AS type, r.p_size - l.p_size AS delta FROM part l JOIN part r ON l.p_name = r.p_name AND l.p_partkey < r.p_partkey WHERE abs(r.p_size - l.p_size) <= 25) SELECT type, count(*) AS n, count(*) FILTER (delta IN ({_SHIFT})) AS n_shift, count(*) FILTER (-delta IN ({_SHIFT})) AS n_mirror, round(count(*) FILTER (delta IN ({_SHIFT})) / greatest(count(*) FILTER (-delta IN ({_SHIFT})), 1), 6) AS ratio FROM p GROUP BY type",
    "dq_validator": "SELECT unnest(['duplicate owner', 'missing owner', 'unknown owner', 'duplicate link', 'unknown record', 'link outside the candidates', 'record with two owners']) AS rule, 0 AS n",
    "result_lists": f"WITH {LINKS} SELECT item_id AS q_id, coalesce(m, '') AS matched FROM benchmark LEFT JOIN (SELECT q_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS m FROM links GROUP BY q_id) l ON l.q_id = item_id",
    "stratified_sample": "SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 5",
    "expected_f05_sets": f"WITH RECURSIVE {POOL}, {EXPECTED} SELECT q_id, k::INT AS k, round(f, 6) AS expected FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(f, 11) DESC, k) AS r FROM w) WHERE r = 1",
    "jaro_winkler_pairs": f"WITH {NAMES} SELECT a, b, round(jaro_winkler_similarity(name_a, name_b), 6) AS jw FROM np",
}
