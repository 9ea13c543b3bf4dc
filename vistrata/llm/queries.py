"""The registered queries of the corpus operators and their SQL checks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from vistrata.llm import (
    classifier, exactdedup, extract, fim, langid, mixing, neardup, phrases, pieces, quality,
    suffixdedup, urlfilter, windowdedup,
)
from vistrata.llm.tables import read


def piece_model() -> str:
    """The model file: ``PIECE_MODEL`` where it is set, else that of the public package."""
    import public_tokenizers

    return os.environ.get("PIECE_MODEL") or str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(read(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(read(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.predict(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.verdicts(read(spark, sf_dir, "documents"), exactdedup.new_index(spark))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), urlfilter.rule_table(spark))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(
        read(spark, sf_dir, "documents"), pieces.load_vocabulary(piece_model()))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowdedup.digests(read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_quality_rules, op3_language_mixture, op4_main_text,
    op5_suffix_dedup, op6_source_mix, op7_quality_classifier, op8_exact_dedup, op9_url_rules,
    op10_sentencepiece, op11_collocations, op12_window_dedup, op13_fill_in_middle)}

_WORD = r"[^\x20\x09-\x0D]"


def _quality_sql() -> str:
    grid = ", ".join(f"('{name}', {place}, {cut})" for name, cuts in quality.GRIDS.items()
                     for place, cut in enumerate(cuts))
    risk, features = quality.RISK, len(quality.GRIDS)
    values = " ".join(f"WHEN '{name}' THEN {name}" for name in quality.GRIDS)
    return f"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
    g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o
                 AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g
          WHERE gram IS NOT NULL),
    cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) AS s(j)
            WHERE c > 1 GROUP BY doc_id),
    l AS (SELECT doc_id, list_filter(string_split(t, chr(10)),
                 lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
    f AS (SELECT d.doc_id, lang AS stratum, CAST(len(ws) AS BIGINT) AS n_words,
            CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT)
              AS n_symbols,
            CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
          FROM d JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)),
    m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            n_symbols / greatest(n_words, 1) AS symbols_per_word,
            n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
            n_repeat_words / greatest(n_words, 1) AS repeat_share,
            word_chars / greatest(n_words, 1) AS word_length FROM f),
    good AS (SELECT doc_id, min(quality) = 1 AS good FROM labels
             WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    h AS (SELECT m.*, good FROM m JOIN good USING (doc_id) WHERE NOT base_failed),
    cells AS (SELECT stratum, feature, place, cut, count(*) FILTER (good) AS n,
                count(*) FILTER (good AND (CASE feature {values} END) > cut) AS k,
                count(*) FILTER (NOT good AND (CASE feature {values} END) > cut) AS bad
              FROM h, (VALUES {grid}) AS grid(feature, place, cut)
              GROUP BY stratum, feature, place, cut),
    tail AS (SELECT *, CASE WHEN k >= n * {risk} THEN 1 ELSE list_sum(list_transform(
               range(0, k + 1), lambda i: exp(
                 CASE WHEN i = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) END
                 + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END AS p FROM cells),
    passed AS (SELECT *, bool_and(p <= {quality.ERROR} / (
                 {features} * (SELECT count(*) FROM (SELECT DISTINCT stratum FROM h))))
               OVER (PARTITION BY stratum, feature ORDER BY place) AS ok FROM tail),
    best AS (SELECT *, row_number() OVER (PARTITION BY stratum, feature
               ORDER BY bad - {quality.COST} * k DESC, place) AS nr
             FROM passed WHERE ok AND bad > {quality.COST} * k),
    rejected AS (SELECT DISTINCT m.doc_id FROM m JOIN best
                 ON m.stratum IS NOT DISTINCT FROM best.stratum AND nr = 1
                 AND (CASE feature {values} END) > cut)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM m"""


def _mixing_sql() -> str:
    weights = "[" + ", ".join(f"{w}.0" for w in mixing.WEIGHTS) + "]"
    return f"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''),
                 '{_WORD}+')) AS BIGINT) AS size,
                 CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[:{mixing.HASH_DIGITS}]
                      AS BIGINT) AS h FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
    w AS (SELECT *, {weights}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1)
                 % {len(mixing.WEIGHTS)}] AS w, {mixing.MAX_PASSES}.0 * s AS lim FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY lim / w, source NULLS LAST) AS nr FROM w),
    c AS (SELECT *, ((SELECT sum(s) FROM w)
                 - coalesce(sum(lim) OVER (ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING
                                           AND 1 PRECEDING), 0))
                 / sum(w) OVER (ORDER BY nr DESC) AS level FROM o),
    lev AS (SELECT coalesce(arg_min(level, nr) FILTER (level * w <= lim), max(lim / w)) AS level FROM c),
    t AS (SELECT source, s, least(lim, level * w)::DOUBLE AS target,
                 CASE WHEN s > 0 THEN floor(least(lim, level * w) / s) ELSE 0 END AS passes
          FROM w, lev),
    a AS (SELECT d.*, s AS source_size, target, passes, target - passes * s AS rest,
                 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN
                   UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE
             WHEN size > 0 AND rest > before + size THEN 1
             WHEN size > 0 AND rest > before AND round((rest - before) / size) >= 1 THEN 1
             ELSE 0 END) AS BIGINT) AS taken FROM a"""


def _dedup_sql() -> str:
    return """
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)"""


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.BASE_RULES)
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://')
                 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (SELECT * FROM (VALUES {rules}) AS t(rule_host, rule_path, verdict)),
    m AS (SELECT p.*, rule_host || rule_path AS rule, verdict, row_number() OVER (
                 PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS nr
          FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host))
                             AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE nr = 1"""


def _phrase_sql() -> str:
    longest, least, (part, whole) = phrases.LONGEST, phrases.LEAST, phrases.SHARE
    runs = " UNION ALL ".join(
        f"SELECT lang, {size} AS size, " + " || ' ' || ".join(["w0", *[
            f"w{j}" for j in range(1, size)]]) + f" AS phrase FROM s WHERE w{size - 1} IS NOT NULL"
        for size in range(1, longest + 1))
    leads = ", ".join(f"lead(word, {j}) OVER o AS w{j}" for j in range(1, longest))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT doc, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS nr FROM (
            SELECT doc, lang, string_split_regex(t, '[.,;:!?\\x0A-\\x0D]') AS ps FROM d)),
    w AS (SELECT doc, lang, nr, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (
            SELECT doc, lang, nr, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p)),
    s AS (SELECT lang, word AS w0, {leads} FROM w
          WINDOW o AS (PARTITION BY doc, nr ORDER BY i)),
    f AS (SELECT lang, size, phrase, count(*) AS f FROM ({runs}) GROUP BY ALL),
    c AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS ws FROM f
          WHERE size >= 2 AND f >= {least}),
    cut AS (SELECT lang, phrase, f AS a, k, array_to_string(ws[:k], ' ') AS lp,
              array_to_string(ws[k + 1:], ' ') AS rp
            FROM c, (SELECT unnest(range(1, {longest})) AS k) WHERE k < size),
    sc AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r,
             (a::HUGEINT * {phrases.SCALE} // (x.f + y.f))::BIGINT AS score
           FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = lp
                    JOIN f AS y ON y.lang = cut.lang AND y.phrase = rp),
    best AS (SELECT * FROM sc QUALIFY row_number() OVER (
               PARTITION BY lang, phrase ORDER BY score, k) = 1),
    held AS (SELECT DISTINCT b.lang, b.phrase FROM best AS b JOIN c ON c.lang = b.lang
               AND c.size > length(b.phrase) - length(replace(b.phrase, ' ', '')) + 1
               AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')
               AND {whole} * c.f >= {part} * b.a),
    kept AS (SELECT b.* FROM best AS b ANTI JOIN held USING (lang, phrase)),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
             AS rank, phrase, a, l, r, n, score
    FROM kept JOIN n USING (lang) QUALIFY rank <= {phrases.TOP}"""


def _window_sql() -> str:
    size = windowdedup.WINDOW
    gram = " || ' ' || ".join(["word", *[f"lead(word, {j}) OVER o" for j in range(1, size)]])
    return f"""
    WITH d AS (SELECT row_number() OVER () AS doc, doc_id,
                 regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws FROM documents),
    w AS (SELECT doc, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
    g AS (SELECT doc, doc_id, i, {gram} AS gram FROM w
          WINDOW o AS (PARTITION BY doc ORDER BY i)),
    r AS (SELECT doc, i FROM g WHERE gram IS NOT NULL QUALIFY
            min(doc_id) OVER (PARTITION BY gram) < coalesce(doc_id, 9223372036854775807)),
    gone AS (SELECT DISTINCT doc, i + j AS i FROM r, (SELECT unnest(range({size})) AS j)),
    k AS (SELECT doc, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
          FROM w ANTI JOIN gone USING (doc, i) GROUP BY doc)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc)"""


def _fim_sql() -> str:
    draw = ", ".join(f"CAST('0x' || sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))"
                     f"[{8 * i + 1}:{8 * i + 8}] AS BIGINT) AS h{i + 1}" for i in range(4))
    marks = " OR ".join(f"contains(t, '{m.decode()}')" for m in fim.RESTORED)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {draw} FROM documents),
    u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us FROM d),
    c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS low,
                 greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS high FROM u),
    f AS (SELECT *, CASE WHEN t = '' OR {marks} OR h3 % 100 >= {fim.RATE} THEN 'plain'
                         WHEN h4 % 100 < {fim.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form,
            coalesce(array_to_string(us[:low], ''), '') AS p,
            coalesce(array_to_string(us[low + 1:high], ''), '') AS m,
            coalesce(array_to_string(us[high + 1:], ''), '') AS s FROM c)
    SELECT doc_id, n::BIGINT AS n, form,
           CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256 FROM f"""


SQL = {
    "op2_quality_rules": _quality_sql(),
    "op6_source_mix": _mixing_sql(),
    "op8_exact_dedup": _dedup_sql(),
    "op9_url_rules": _url_sql(),
    "op11_collocations": _phrase_sql(),
    "op12_window_dedup": _window_sql(),
    "op13_fill_in_middle": _fim_sql(),
}
