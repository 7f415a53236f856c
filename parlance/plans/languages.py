"""Queries of language detection (H11), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parlance.functions import language
from parlance.operators import words
from parlance.plans.catalog import _read, query

_GRAMS = """d AS (SELECT doc_id, lang, text, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL),
  g AS (SELECT doc_id, lang, substr(t, k, 3) AS gram FROM (SELECT doc_id, lang, t, unnest(range(1, greatest(length(t) - 1, 1))) AS k FROM d WHERE length(t) > 2) x WHERE trim(substr(t, k, 3)) <> ''),
  p AS (SELECT lang, gram, rank FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram)::INTEGER AS rank FROM g WHERE lang IS NOT NULL GROUP BY lang, gram) r WHERE rank <= 300)"""


def _profiles(s: SparkSession, d: str) -> DataFrame:
    return language.profiles(_read(s, d, "SELECT text, lang FROM {documents}"))


query("h11_language_profiles", f"WITH {_GRAMS} SELECT lang, gram, rank FROM p")(_profiles)
#: The SQL knows no scripts but the Latin one, which all documents are in.
query(
    "h11_told_languages",
    f"""WITH {_GRAMS}, c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY doc_id, gram), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS k, count(*) OVER (PARTITION BY doc_id) AS kinds FROM c),
    o AS (SELECT * FROM r WHERE k <= 300), l AS (SELECT DISTINCT lang FROM p),
    a AS (SELECT doc_id, l.lang, any_value(kinds) AS kinds, 300 * count(*) - sum(CASE WHEN p.rank IS NULL THEN 300 ELSE least(300, abs(k - p.rank)) END) AS score FROM o CROSS JOIN l LEFT JOIN p ON p.lang = l.lang AND p.gram = o.gram GROUP BY doc_id, l.lang),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS place, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS second FROM a)
    SELECT d.doc_id, CASE WHEN len(regexp_extract_all(d.text, '\\p{{L}}')) >= 40 AND score > 0 AND least(1.0, (score - coalesce(second, 0)) / greatest(coalesce(second, 0), 1) / (12 / kinds + 0.05)) >= 0.5 THEN b.lang END AS lang
    FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND place = 1""",
)(
    lambda s, d: _read(s, d, "SELECT doc_id, text FROM {documents} WHERE text IS NOT NULL").select(
        "doc_id", words.detected_language(F.col("text"), language.detector(_profiles(s, d))).alias("lang")
    )
)
