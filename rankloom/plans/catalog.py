"""The test tables as a catalogue of items and profiles, in Spark and in SQL.

Ranking is a search: the profiles that ask are the customers whose key is divisible by
20, and each is put to every item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.operators.similarity import STOP_WORDS

ITEMS_SPARK = """
SELECT cast(p_partkey AS string) AS item_id,
  CASE WHEN p_partkey % 4 = 0 THEN 'live_feed' ELSE 'board' END AS source,
  concat('HTTPS://www.Example', p_partkey % 50, '.org/Awards/', p_partkey, '/?b=2&a=1#top') AS source_url,
  p_name AS title, p_brand AS sponsor, concat(p_type, '  ', p_name) AS description,
  cast(NULL AS string) AS eligibility_text, cast(NULL AS string) AS essay_prompt,
  CASE WHEN p_size % 11 <> 0 THEN date_add(DATE'1998-01-01', p_size * 10) END AS deadline,
  CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS amount_min,
  CASE WHEN p_size % 7 <> 0 THEN p_retailprice * p_size END AS amount_max,
  p_size % 2 = 0 AS essay_required,
  CASE WHEN p_partkey % 3 = 0 THEN transform(sequence(0, 9), i -> concat(' Nation_', (p_size * 7 + i * 2) % 25)) END AS states_allowed,
  CASE WHEN p_partkey % 5 = 0 THEN array('BUILDING', 'MACHINERY') WHEN p_partkey % 5 = 1 THEN array('furniture ', '') END AS majors_allowed,
  CASE WHEN p_size % 3 <> 0 THEN p_type END AS education_level,
  CASE WHEN p_partkey % 7 = 0 THEN 'US' END AS citizenship,
  CASE WHEN p_size % 4 = 0 THEN cast(p_size AS double) / cast(12.5 AS double) END AS min_gpa,
  split(p_name, ' ') AS keywords
FROM {part}
"""

PROFILES_SPARK = """
SELECT concat('p', c_custkey) AS profile_id, greatest(cast(0 AS double), least(cast(4 AS double), c_acctbal / cast(2500 AS double))) AS gpa,
  concat('NATION_', c_nationkey) AS state, c_mktsegment AS major,
  element_at(array('standard', 'medium', 'economy', 'promo', 'large', 'small'), cast(c_custkey % 6 AS int) + 1) AS education_level,
  CASE WHEN c_custkey % 3 <> 0 THEN 'us' END AS citizenship, DATE'1998-06-01' AS today,
  CASE c_custkey % 4 WHEN 0 THEN array('red', 'Widget') WHEN 1 THEN array('blue bolt') WHEN 2 THEN array('hot', 'gear', 'ring') ELSE array('small') END AS keywords,
  array('cold') AS interests, cast(array() AS array<string>) AS extracurriculars, concat('find the best ', c_mktsegment, ' bolt') AS goals
FROM {customer} WHERE c_custkey % 20 = 0
"""

ITEMS_SQL = """
items AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id,
  CASE WHEN p_partkey % 4 = 0 THEN 'live_feed' ELSE 'board' END AS source,
  concat('HTTPS://www.Example', p_partkey % 50, '.org/Awards/', p_partkey, '/?b=2&a=1#top') AS source_url,
  p_name AS title, p_brand AS sponsor, concat(p_type, '  ', p_name) AS description,
  CAST(NULL AS VARCHAR) AS eligibility_text, CAST(NULL AS VARCHAR) AS essay_prompt,
  CASE WHEN p_size % 11 <> 0 THEN DATE '1998-01-01' + p_size * 10 END AS deadline,
  CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS amount_min,
  CASE WHEN p_size % 7 <> 0 THEN p_retailprice * p_size END AS amount_max,
  p_size % 2 = 0 AS essay_required,
  CASE WHEN p_partkey % 3 = 0 THEN list_transform(range(0, 10), lambda i: concat('nation_', (p_size * 7 + i * 2) % 25)) ELSE CAST([] AS VARCHAR[]) END AS states_allowed,
  CASE WHEN p_partkey % 5 = 0 THEN ['building', 'machinery'] WHEN p_partkey % 5 = 1 THEN ['furniture'] ELSE CAST([] AS VARCHAR[]) END AS majors_allowed,
  CASE WHEN p_size % 3 <> 0 THEN lower(p_type) ELSE '' END AS education_level,
  CASE WHEN p_partkey % 7 = 0 THEN 'us' ELSE '' END AS citizenship,
  CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS DOUBLE) / CAST(12.5 AS DOUBLE) END AS min_gpa,
  string_split(p_name, ' ') AS keywords, p_size, p_partkey FROM part)
"""

PROFILES_SQL = """
profiles AS (SELECT concat('p', c_custkey) AS profile_id, greatest(CAST(0 AS DOUBLE), least(CAST(4 AS DOUBLE), c_acctbal / CAST(2500 AS DOUBLE))) AS gpa,
  lower(concat('NATION_', c_nationkey)) AS state, lower(c_mktsegment) AS major,
  (['standard', 'medium', 'economy', 'promo', 'large', 'small'])[CAST(c_custkey % 6 AS INT) + 1] AS p_level,
  CASE WHEN c_custkey % 3 <> 0 THEN 'us' ELSE '' END AS p_citizenship, DATE '1998-06-01' AS today,
  CASE c_custkey % 4 WHEN 0 THEN ['red', 'widget', 'cold'] WHEN 1 THEN ['blue', 'bolt', 'cold'] WHEN 2 THEN ['hot', 'gear', 'ring', 'cold'] ELSE ['small', 'cold'] END AS wanted,
  concat(lower(c_mktsegment), ' cold ', CASE c_custkey % 4 WHEN 0 THEN 'red widget' WHEN 1 THEN 'blue bolt' WHEN 2 THEN 'hot gear ring' ELSE 'small' END, ' find the best ', lower(c_mktsegment), ' bolt') AS ptext
  FROM customer WHERE c_custkey % 20 = 0)
"""

PAIRS_SQL = f"""{ITEMS_SQL}, {PROFILES_SQL},
pairs AS (SELECT i.*, p.*, list_filter([
  CASE WHEN deadline < today THEN 'DEADLINE_PASSED' END, CASE WHEN gpa < min_gpa THEN 'GPA_BELOW_MIN' END,
  CASE WHEN len(states_allowed) > 0 AND NOT list_contains(states_allowed, state) THEN 'STATE_NOT_ALLOWED' END,
  CASE WHEN len(majors_allowed) > 0 AND NOT list_contains(majors_allowed, major) THEN 'MAJOR_NOT_ALLOWED' END,
  CASE WHEN education_level <> '' AND education_level <> p_level THEN 'EDUCATION_LEVEL_MISMATCH' END,
  CASE WHEN citizenship <> '' AND citizenship <> p_citizenship THEN 'CITIZENSHIP_MISMATCH' END], lambda x: x IS NOT NULL) AS reasons
  FROM items i CROSS JOIN profiles p)"""

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
WORDS_SQL = "list_filter(regexp_extract_all({t}, '[0-9A-Za-z_]{{2,}}'), lambda x: x NOT IN ({stop}))"
TERMS_SQL = "SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])))) AS term FROM (SELECT {key}, {words} AS ws FROM {table})) GROUP BY ALL"
ITEM_TERMS = TERMS_SQL.format(key="item_id", table="items", words=WORDS_SQL.format(t="concat_ws(' ', lower(title), lower(sponsor), trim(lower(description)))", stop=STOP))
PROFILE_TERMS = TERMS_SQL.format(key="profile_id", table="profiles", words=WORDS_SQL.format(t="ptext", stop=STOP))
SIM_SQL = f"""{PAIRS_SQL},
el AS (SELECT profile_id, item_id FROM pairs WHERE len(reasons) = 0),
it AS ({ITEM_TERMS}), pt AS ({PROFILE_TERMS}),
tr AS (SELECT el.profile_id, el.item_id, it.term, it.tf FROM el JOIN it USING (item_id)),
nn AS (SELECT profile_id, count(*) + 1 AS n FROM el GROUP BY profile_id),
df AS (SELECT profile_id, term, count(*) AS df FROM (SELECT profile_id, term FROM tr UNION ALL SELECT profile_id, term FROM pt) GROUP BY ALL),
kn AS (SELECT df.profile_id, df.term, ln(CAST(1 + n AS DOUBLE) / (1 + df)) + 1 AS idf, coalesce(pt.tf, 0) * (ln(CAST(1 + n AS DOUBLE) / (1 + df)) + 1) AS pw FROM df JOIN nn USING (profile_id) LEFT JOIN pt ON pt.profile_id = df.profile_id AND pt.term = df.term),
pn AS (SELECT profile_id, sqrt(sum(pw * pw)) AS pl FROM kn GROUP BY profile_id),
ds AS (SELECT tr.profile_id, tr.item_id, sum(tf * idf * tf * idf) AS s2, sum(tf * idf * pw) AS s FROM tr JOIN kn ON kn.profile_id = tr.profile_id AND kn.term = tr.term GROUP BY ALL),
sim AS (SELECT el.profile_id, el.item_id, coalesce(round(s / nullif(sqrt(s2) * pn.pl, 0), 9), CAST(0 AS DOUBLE)) AS text_sim FROM el LEFT JOIN ds USING (profile_id, item_id) LEFT JOIN pn USING (profile_id))"""

AMOUNT = "coalesce(amount_max, amount_min, CAST(0 AS DOUBLE))"
SCORED_SQL = f"""{SIM_SQL},
base AS (SELECT pairs.*, text_sim, {AMOUNT} AS amt, CAST(len(list_intersect(wanted, keywords)) AS DOUBLE) / len(wanted) AS keyword_overlap,
  CASE WHEN essay_required THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS effort_penalty, CAST(date_diff('day', today, deadline) AS DOUBLE) AS days_to_deadline,
  CASE WHEN essay_required THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS effort_cost FROM pairs JOIN sim USING (profile_id, item_id)),
scored AS (SELECT *, ln(1 + amt) / ln(1 + max(amt) OVER w) AS amount_utility, amt / max(amt) OVER w AS amount_linear, amt / effort_cost AS ev_proxy,
  CASE WHEN days_to_deadline IS NULL THEN CAST(0 AS DOUBLE) ELSE exp(-greatest(days_to_deadline, CAST(0 AS DOUBLE)) / CAST(30 AS DOUBLE)) END AS urgency
  FROM base WINDOW w AS (PARTITION BY profile_id)),
staged AS (SELECT *, least(greatest(CAST(0.7 AS DOUBLE) * text_sim + CAST(0.2 AS DOUBLE) * amount_utility + CAST(0.1 AS DOUBLE) * keyword_overlap - CAST(0.1 AS DOUBLE) * effort_penalty, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS stage_score,
  CASE WHEN max(ev_proxy) OVER w > min(ev_proxy) OVER w THEN (ev_proxy - min(ev_proxy) OVER w) / (max(ev_proxy) OVER w - min(ev_proxy) OVER w) ELSE CAST(0 AS DOUBLE) END AS ev_norm
  FROM scored WINDOW w AS (PARTITION BY profile_id)),
ranked AS (SELECT *, CAST(0.8 AS DOUBLE) * stage_score + CAST(0.15 AS DOUBLE) * urgency + CAST(0.05 AS DOUBLE) * ev_norm AS final_score FROM staged),
placed AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY round(final_score, 10) DESC, deadline ASC NULLS LAST, item_id ASC) AS place FROM ranked),
top AS (SELECT * FROM placed WHERE place <= 10)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ITEMS_SPARK, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROFILES_SPARK, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
