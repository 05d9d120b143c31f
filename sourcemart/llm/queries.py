"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcemart.llm.common import fold


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark, folder):
    from sourcemart.llm.quality import score_quality
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), learn=fold("doc_id", 5) != 0,
                         carry={"held_out": fold("doc_id", 5) == 0})


def op2_lm_score(spark, folder):
    from sourcemart.llm.context_tree import score_texts
    return score_texts(table(spark, folder, "documents"), learn=fold("doc_id", 7) != 2, carry={"held_out": fold("doc_id", 7) == 2})


def op3_language(spark, folder):
    from sourcemart.llm.language_id import identify
    return identify(table(spark, folder, "documents"), learn=fold("doc_id", 4) != 2, carry={"held_out": fold("doc_id", 4) == 2})


def op4_jaccard_join(spark, folder):
    from sourcemart.llm.jaccard_join import similar_components
    return similar_components(table(spark, folder, "documents"), width=3, percent=90)


def op5_html_text(spark, folder):
    from sourcemart.llm.html_text import extract_pages
    return extract_pages(table(spark, folder, "pages"))


def op6_personal_data(spark, folder):
    from sourcemart.llm.personal_data import find_personal_data
    return find_personal_data(table(spark, folder, "documents"))


def op7_mixing(spark, folder):
    from sourcemart.llm.mixing import mix_positions
    return mix_positions(table(spark, folder, "documents"))


def op8_packing(spark, folder):
    from sourcemart.llm.packing import pack
    return pack(table(spark, folder, "documents"))


def op9_line_rules(spark, folder):
    from sourcemart.llm.line_frequency import quality_rules
    return quality_rules(table(spark, folder, "documents"))


def op10_exact_dedup(spark, folder):
    from sourcemart.llm.exact_dedup import exact_duplicates
    return exact_duplicates(table(spark, folder, "documents"))


def op11_best_fit_packing(spark, folder):
    from sourcemart.llm.complement_packing import pack_best_fit
    return pack_best_fit(table(spark, folder, "documents"))


def op12_alignment(spark, folder):
    from sourcemart.llm.alignment import align
    return align(table(spark, folder, "documents"))


def op13_collocations(spark, folder):
    from sourcemart.llm.phrases import collocations
    return collocations(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_lm_score, op3_language, op4_jaccard_join, op5_html_text, op6_personal_data, op7_mixing, op8_packing,
                                   op9_line_rules, op10_exact_dedup, op11_best_fit_packing, op12_alignment, op13_collocations)}

ORACLE_SQL = {
    "op13_collocations": r"""WITH pieces AS (SELECT row_number() OVER () AS piece, lang, p FROM (SELECT coalesce(lang, 'und') AS lang,
            unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
        words AS (SELECT piece, lang, unnest(w) AS w1, unnest(range(len(w))) AS i FROM
            (SELECT piece, lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces)),
        follow AS (SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)),
        f1 AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM follow GROUP BY ALL),
        f2 AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM follow WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM follow WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
        cuts AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k
            FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
            LEFT JOIN longer o ON o.lang = f2.lang AND o.w1 = f2.w1 AND o.w2 = f2.w2 WHERE o.f IS NULL OR 100 * o.f < 50 * f2.f
            UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 1
            FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
            UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 2
            FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
        best AS (SELECT *, 1000000 * a * a // (l * r) AS score FROM cuts
            QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY 1000000 * a * a // (l * r), k) = 1),
        totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
            a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM best JOIN totals USING (lang) QUALIFY rank <= 2000""",
    "op10_exact_dedup": r"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
            sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
            row_number() OVER best = 1 AS kept, sha AS text_sha256
        FROM t WINDOW best AS (PARTITION BY sha ORDER BY chars DESC, doc_id)""",
    "op9_line_rules": r"""WITH w AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
        starts AS (SELECT row, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
        windows AS (SELECT row, i, count(*) OVER (PARTITION BY row, array_to_string(words[i:i + 7], ' ')) AS n FROM starts),
        places AS (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS next FROM windows WHERE n > 1),
        repeated AS (SELECT row, sum(least(8, coalesce(next - i, 8))) AS n FROM places GROUP BY row),
        line AS (SELECT DISTINCT row, host, text, lower(regexp_replace(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            '[\x20\x09-\x0D]+', ' ', 'g')) AS l FROM (SELECT row, host, text, unnest(lines) AS l FROM w)),
        hosts AS (SELECT host, count(DISTINCT text) AS docs FROM w GROUP BY host),
        boilerplate AS (SELECT host, l FROM line JOIN hosts USING (host) GROUP BY host, l
            HAVING count(DISTINCT text) > 30 AND count(DISTINCT text) > max(docs) * cast(0.1 AS DOUBLE)),
        sized AS (SELECT line.*, length(line.l) - length(replace(line.l, ' ', '')) + 1 AS size, b.l IS NOT NULL AS gone
            FROM line LEFT JOIN boilerplate b ON b.host = line.host AND b.l = line.l),
        removed AS (SELECT row, sum(size) AS all_words, sum(CASE WHEN gone THEN size ELSE 0 END) AS removed FROM sized GROUP BY row),
        counted AS (SELECT w.row, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
            coalesce(m.removed, 0)::BIGINT AS removed_words, coalesce(m.all_words, 0) AS all_words
            FROM w LEFT JOIN repeated r USING (row) LEFT JOIN removed m USING (row))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, removed_words,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (removed_words > 0 AND
                (all_words - removed_words < 20 OR all_words - removed_words < cast(0.3 AS DOUBLE) * all_words)) AS kept FROM counted""",
}
