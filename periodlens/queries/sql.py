"""Building blocks of the reference SQL: common table expressions over the supplied tables."""

from __future__ import annotations

from periodlens.queries.inputs import FEATURES, LABELS, NAMES

MONTH = "(year(l_shipdate) * 12 + month(l_shipdate) - 1)::INTEGER"
DAY = "date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER"
PERIOD = "regexp_extract(source, '([0-9]+)', 1)::INTEGER"

MONTH_SERIES = "long AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS series, {MONTH} AS t, round(avg({f}), 6) AS x FROM lineitem GROUP BY 2" for f in FEATURES
) + ")"
MONTH_SCORES = MONTH_SERIES.replace("long AS (", "raw AS (", 1) + """, long AS (
    SELECT series, t, (x - avg(x) OVER (PARTITION BY series)) / stddev_pop(x) OVER (PARTITION BY series) AS x FROM raw)"""
SUPPLIER_SERIES = f"""long AS (SELECT l_suppkey::VARCHAR || ':l_quantity' AS series, {MONTH} AS t,
    round(avg(l_quantity), 6) AS x FROM lineitem GROUP BY l_suppkey, 2)"""
DAY_SERIES = f"long AS (SELECT 'value' AS series, {DAY} AS t, round(avg(value), 6) AS x FROM events GROUP BY 2)"

# Mann-Kendall by its definition, over all pairs. Needs `long`.
MANN_KENDALL = """
pairs AS (SELECT a.series, a.t AS t1, b.t AS t2, a.x AS x1, b.x AS x2
          FROM long a JOIN long b ON a.series = b.series AND a.t < b.t),
size AS (SELECT series, count(*) AS n FROM long GROUP BY 1),
groups AS (SELECT series, x, count(*) AS c FROM long GROUP BY 1, 2),
ties AS (SELECT series, sum(c * (c - 1) * (2 * c + 5)) AS tv, sum(c * (c - 1) / 2.0) AS tp FROM groups GROUP BY 1),
score AS (SELECT series, sum(CASE WHEN x2 > x1 THEN 1 WHEN x2 < x1 THEN -1 ELSE 0 END)::BIGINT AS s FROM pairs GROUP BY 1),
base AS (SELECT series, n, s, (n * (n - 1) * (2.0 * n + 5) - tv) / 18.0 AS var_s, n * (n - 1) / 2.0 AS n0, tp
         FROM size JOIN score USING (series) JOIN ties USING (series) WHERE n >= 3),
mk AS (SELECT series, n, s, var_s::DOUBLE AS var_s,
              CASE WHEN s = 0 THEN 0.0 ELSE (s - sign(s)) / sqrt(var_s::DOUBLE) END::DOUBLE AS z,
              CASE WHEN n0 > tp THEN s / sqrt(((n0 - tp) * n0)::DOUBLE) END::DOUBLE AS tau FROM base)"""

# Two-sided normal p by the power series of the error function. Needs `mk`; adds `mkp`.
NORMAL_P = """
mkp AS (SELECT mk.*, CASE WHEN z = 0 THEN 1.0 ELSE (SELECT 1 - sum(exp(-z * z / 2 + (2 * k + 1) * ln(abs(z) / sqrt(2.0))
          - lgamma(k + 1.5))) FROM range(200) r(k)) END AS p_raw FROM mk)"""

# Sen's slope from the sorted list of all slopes. Needs `pairs` and `base`.
SEN = """
slopes AS (SELECT series, list_sort(list((x2 - x1) / (t2 - t1))) AS sl, count(*) AS nn FROM pairs GROUP BY 1),
pos AS (SELECT series, sl, nn, (nn + 1) / 2.0::DOUBLE AS rm,
               greatest(1.0::DOUBLE, least(nn::DOUBLE, (nn - 1.959963984540054 * sqrt(var_s::DOUBLE)) / 2.0)) AS rl,
               greatest(1.0::DOUBLE, least(nn::DOUBLE, (nn + 1.959963984540054 * sqrt(var_s::DOUBLE)) / 2.0 + 1)) AS rh
        FROM slopes JOIN base USING (series)),
vals AS (SELECT series,
    sl[floor(rm)::INT] + (sl[ceil(rm)::INT] - sl[floor(rm)::INT]) * (rm - floor(rm)) AS slope,
    sl[floor(rl)::INT] + (sl[ceil(rl)::INT] - sl[floor(rl)::INT]) * (rl - floor(rl)) AS lo,
    sl[floor(rh)::INT] + (sl[ceil(rh)::INT] - sl[floor(rh)::INT]) * (rh - floor(rh)) AS hi FROM pos),
sen AS (SELECT series, slope, least(lo, slope) AS ci_lo, greatest(hi, slope) AS ci_hi FROM vals)"""

# Pettitt from sums of signs against all other points. Needs `long`.
PETTITT = """
v AS (SELECT a.series, a.t, count(*) AS n, sum(CASE WHEN a.x > b.x THEN 1 WHEN a.x < b.x THEN -1 ELSE 0 END)::BIGINT AS v
      FROM long a JOIN long b USING (series) GROUP BY 1, 2),
walk AS (SELECT series, t, n, sum(v) OVER w AS u, lead(t) OVER w AS next_t FROM v WINDOW w AS (PARTITION BY series ORDER BY t)),
pet AS (SELECT series, n, abs(u)::BIGINT AS k, next_t AS break_t FROM walk WHERE next_t IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY series ORDER BY abs(u) DESC, t) = 1),
pettitt AS (SELECT series, n, k, break_t, least(1.0, 2.0 * exp(-6.0 * k * k / (n * n * n + n * n))) AS p FROM pet)"""


def fdr(table: str, p: str, out: str, family: str = "") -> str:
    """Benjamini-Hochberg over the rows of a table as CTE ``out``."""
    part = f"PARTITION BY {family}" if family else ""
    return f"""
{out}_r AS (SELECT *, row_number() OVER ({part} ORDER BY {p}) AS _rk, count(*) OVER ({part}) AS _m FROM {table}),
{out} AS (SELECT * EXCLUDE (_rk, _m), least(1.0, min({p} * _m / _rk) OVER ({part} ORDER BY _rk DESC)) AS p_bh FROM {out}_r)"""


def partitions(max_breaks: int, long: str = "long") -> str:
    """Best segmentation for every number of breaks: one join per round. Gives ``parts`` (series, n, d, m, sse, path).

    A table with a ``dim`` column is taken as multivariate.
    """
    out = [
        f"""pts AS (SELECT series, dim, t, x - avg(x) OVER (PARTITION BY series, dim) AS x,
            row_number() OVER (PARTITION BY series, dim ORDER BY t) AS pos FROM {long})""",
        """pref AS (SELECT series, dim, pos, sum(x) OVER w AS p1, sum(x * x) OVER w AS p2 FROM pts
            WINDOW w AS (PARTITION BY series, dim ORDER BY pos)
            UNION ALL SELECT DISTINCT series, dim, 0, 0.0, 0.0 FROM pts)""",
        "dims AS (SELECT series, max(pos) AS n, count(DISTINCT dim) AS d FROM pts GROUP BY 1)",
        "names AS (SELECT DISTINCT series, pos, t FROM pts)",
        """seg AS (SELECT a.series, a.pos AS s, b.pos AS b,
            sum((b.p2 - a.p2) - (b.p1 - a.p1) * (b.p1 - a.p1) / (b.pos - a.pos)) AS c
            FROM pref a JOIN pref b ON a.series = b.series AND a.dim = b.dim AND a.pos < b.pos GROUP BY 1, 2, 3)""",
        "c0 AS MATERIALIZED (SELECT series, b, c AS cost, '' AS path FROM seg WHERE s = 0)",
    ]
    for j in range(1, max_breaks + 1):
        out.append(f"""c{j} AS MATERIALIZED (SELECT series, b, min(cost) AS cost, arg_min(path, (cost, s)) AS path FROM (
            SELECT g.series, g.b, g.s, p.cost + g.c AS cost,
                   p.path || CASE WHEN p.path = '' THEN '' ELSE ';' END || w.t AS path
            FROM seg g JOIN c{j - 1} p ON g.series = p.series AND g.s = p.b
            JOIN names w ON w.series = g.series AND w.pos = g.s + 1 WHERE g.s >= {j}) GROUP BY 1, 2)""")
    rounds = " UNION ALL ".join(
        f"SELECT c.series, n, d, {j} AS m, cost AS sse, path FROM c{j} c JOIN dims u ON c.series = u.series AND c.b = u.n"
        for j in range(max_breaks + 1)
    )
    out.append(f"parts AS ({rounds})")
    return ",\n".join(out)


# Penalised choice of the number of breaks. Needs `parts`.
CHOSEN = """
bic AS (SELECT *, n * d * ln(greatest(sse, 1e-12) / (n * d)) + ((m + 1) * d + m + 1) * ln(n * d) AS bic FROM parts),
chosen AS (SELECT * FROM bic QUALIFY row_number() OVER (PARTITION BY series ORDER BY bic, m) = 1)"""

_AWAY = """list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({a}, {b}),
    lambda e: ((e[1] - e[2]) / 1e9) * ((e[1] - e[2]) / 1e9))), lambda s, e: s + e)"""


def eras(points: str, most: int = 10, rounds: int = 20) -> str:
    """K-Means for 2 to ``most`` clusters as ``curve`` (k, wssse), ``best_k`` (k, wssse) and ``era`` (p, cluster).

    ``points`` has (p, v), v a list of features. Centres start far apart in the order of p; scores and centres lie on a grid of 1e-9.
    Lloyd's steps are repeated ``rounds`` times: where no centre moves any more, they change nothing.
    """
    away = _AWAY.format(a="z.v", b="f.v")
    out = [
        f"""dims AS (SELECT i, avg(x) AS mean, stddev_samp(x) AS sd FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM {points}) GROUP BY 1),
        z AS MATERIALIZED (SELECT p, list(CASE WHEN sd > 0 THEN floor((x - mean) / sd * 1e9 + 0.5) ELSE 0.0 END ORDER BY i) AS v
            FROM (SELECT p, unnest(v) AS x, unnest(range(len(v))) AS i FROM {points}) JOIN dims USING (i) GROUP BY p)""",
        "f1 AS MATERIALIZED (SELECT 1 AS c, v FROM z ORDER BY p LIMIT 1)",
    ]
    for j in range(2, most + 1):
        out.append(f"""f{j} AS MATERIALIZED (SELECT * FROM f{j - 1} UNION ALL (SELECT {j}, v FROM (
            SELECT z.p, any_value(z.v) AS v, min({away}) AS d FROM z, f{j - 1} f GROUP BY z.p) ORDER BY d DESC, p LIMIT 1))""")
    out.append(f"c0 AS MATERIALIZED (SELECT k, c, v FROM f{most}, range(2, {most + 1}) r(k) WHERE c <= k)")

    def near(j: int) -> str:
        return f"""SELECT f.k, z.p, z.v, f.c, {away} AS d FROM z, c{j} f
            QUALIFY row_number() OVER (PARTITION BY f.k, z.p ORDER BY d, f.c) = 1"""

    for j in range(1, rounds + 1):
        out.append(f"""c{j} AS MATERIALIZED (SELECT o.k, o.c, coalesce(n.v, o.v) AS v FROM c{j - 1} o LEFT JOIN (
            SELECT k, c, list(m ORDER BY i) AS v FROM (SELECT k, c, i, floor(sum(x::HUGEINT)::DOUBLE / count(*) + 0.5) AS m
                FROM (SELECT k, c, unnest(v) AS x, unnest(range(len(v))) AS i FROM ({near(j - 1)})) GROUP BY 1, 2, 3) GROUP BY 1, 2) n
            ON o.k = n.k AND o.c = n.c)""")
    out.append(f"""held AS MATERIALIZED ({near(rounds)}),
        curve AS (SELECT k::INTEGER AS k, sum(floor(d * 1e9 + 0.5)::HUGEINT)::DOUBLE / 1e9 AS wssse FROM held GROUP BY 1),
        ends AS (SELECT min(k) AS x1, max(k) AS x2, arg_min(wssse, k) AS y1, arg_max(wssse, k) AS y2 FROM curve),
        best_k AS (SELECT k, wssse FROM curve, ends ORDER BY abs((y2 - y1) * k - (x2 - x1) * wssse + x2 * y1 - x1 * y2) DESC, k LIMIT 1),
        era AS (SELECT p, (dense_rank() OVER (ORDER BY first) - 1)::INTEGER AS cluster
            FROM (SELECT p, min(p) OVER (PARTITION BY c) AS first FROM held WHERE k = (SELECT k FROM best_k)))""")
    return ",\n".join(out)


def month_means(features: list[str] | tuple[str, ...], name: str = "pts") -> str:
    """Monthly means of some columns as points."""
    listed = ", ".join(f"avg({f})::DOUBLE" for f in features)
    return f"{name} AS (SELECT {MONTH} AS p, [{listed}] AS v FROM lineitem GROUP BY 1)"


def mix_points(period: str, category: str, table: str, name: str = "pts") -> str:
    """Shares of all categories per period as points, and the counts as ``counted``."""
    return f"""counted AS (SELECT {period} AS p, {category} AS g, count(*) AS n FROM {table} WHERE {category} IS NOT NULL GROUP BY 1, 2),
        {name} AS (SELECT p, list(coalesce(n, 0)::DOUBLE / total ORDER BY g) AS v
            FROM (SELECT p, sum(n) AS total FROM counted GROUP BY 1) CROSS JOIN (SELECT DISTINCT g FROM counted)
            LEFT JOIN counted USING (p, g) GROUP BY p)"""


BLANKS = "(" + " || ".join(f"chr({i})" for i in range(1, 33)) + ")"
WORDS = r"regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+')"


def lines(text: str) -> str:
    """List of trimmed, non-empty lines."""
    return (
        f"list_filter(list_transform(string_split(replace({text}, '\\n', chr(10)), chr(10)), "
        f"lambda s: trim(s, {BLANKS})), lambda s: s <> '')"
    )


def count_words(text: str, words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter({WORDS.format(text=text)}, lambda w: w IN ({listed})))"


CHUNKS = f"""
lined AS (SELECT doc_id, lang, {PERIOD} AS period, {lines('text')} AS ls FROM documents),
chunks AS (SELECT doc_id, lang, period, (i // 8)::INTEGER AS chunk_no, array_to_string(ls[i + 1 : i + 8], ' ') AS chunk
           FROM (SELECT *, unnest(range(0, len(ls), 8)) AS i FROM lined))"""


def scored(source: str, text: str, out: str) -> str:
    """Lexicon matches per label, their sum and the first label with most of them, as CTE ``out``."""
    counts = ", ".join(f"{count_words(text, w)} AS w_{n}" for n, w in LABELS.items())
    total = " + ".join(f"w_{n}" for n in NAMES)
    top = "greatest(" + ", ".join(f"w_{n}" for n in NAMES) + ")"
    pick = " ".join(f"WHEN w_{n} = {top} THEN '{n}'" for n in NAMES)
    confs = ", ".join(f"CASE WHEN {total} > 0 THEN w_{n}::DOUBLE / ({total}) END AS conf_{n}" for n in NAMES)
    return f"""
{out}_w AS (SELECT *, {counts} FROM {source}),
{out} AS (SELECT *, {confs}, CASE WHEN {total} = 0 THEN NULL {pick} END AS dominant_label FROM {out}_w)"""


TOP = "greatest(" + ", ".join(NAMES) + ")"
TIED = "(" + " + ".join(f"({n} = {TOP} AND {TOP} > 0)::INTEGER" for n in NAMES) + ")"
FIRST = f"CASE WHEN {TOP} = 0 THEN NULL " + " ".join(f"WHEN {n} = {TOP} THEN '{n}'" for n in NAMES) + " END"

# Label counts per document with the sum of confidences, as `counts`.
COUNTS = (
    CHUNKS + "," + scored("chunks", "chunk", "lab") + ",\ncounts AS (SELECT doc_id, lang, period, "
    + ", ".join(f"count(*) FILTER (dominant_label = '{n}') AS {n}" for n in NAMES) + ", "
    + ", ".join(f"sum(conf_{n}) AS sum_conf_{n}" for n in NAMES)
    + " FROM lab GROUP BY 1, 2, 3)"
)


def weight(name: str) -> str:
    return f"CASE WHEN {name} = {TOP} AND {TOP} > 0 THEN 1.0::DOUBLE / {TIED} ELSE 0.0 END"
