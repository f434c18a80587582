"""DuckDB counterparts of the queries."""

from __future__ import annotations

from genoplane.plans.reference_checks import genome_sql, visible_sql, word_sql

_FEATURES = ("feature_a", "feature_c", "feature_d", "feature_e", "feature_f", "feature_g", "feature_h")
_NEAR = " AND ".join(f"(CASE WHEN e.{f} IS NULL OR t.{f} IS NULL THEN e.{f} IS NULL AND t.{f} IS NULL ELSE abs(e.{f} - t.{f}) <= 0.005 * greatest(abs(e.{f}), abs(t.{f})) END)" for f in _FEATURES)
_P1 = f"""
seen AS (SELECT *, {visible_sql("source_genome_id")} AS s, {word_sql("dataset_role")} AS role FROM grouped_training_dataset),
keyed AS (SELECT *, {genome_sql("s")} AS genome FROM seen),
ev AS (SELECT * FROM keyed WHERE role IN ('externaltest', 'acceptancetest', 'edgecase')),
tr AS (SELECT * FROM keyed WHERE role = 'traincandidate'),
hits AS (
  SELECT e.record_id, e.role, e.genome, coalesce(e.genome IN (SELECT genome FROM tr WHERE genome IS NOT NULL), false) AS by_genome,
    EXISTS (SELECT 1 FROM tr t WHERE e.feature_b IS NOT DISTINCT FROM t.feature_b AND {_NEAR}) AS by_features
  FROM ev e)
"""
_TARGET = f"nullif({word_sql('taxonomy_group')}, 'unclassified') AS g, {word_sql('target_label')} AS l, CASE WHEN upper({word_sql('evidence_tier')}) IN ('A', 'B', 'C') THEN upper({word_sql('evidence_tier')}) END AS t"
_P3 = f"""
counted AS (SELECT g, l, t, count(DISTINCT k) AS available FROM (SELECT {_TARGET}, nullif(lower(trim(assembly_accession, e' \\t\\n')), '') AS k FROM label_manifest) GROUP BY ALL),
spec AS (SELECT *, {_TARGET} FROM sample_target),
report AS (SELECT spec.*, coalesce(available, 0) AS available, greatest(min_rows::DOUBLE, target_share * sample_rows) AS wanted FROM spec LEFT JOIN counted USING (g, l, t))
"""
_P4 = f"""
labels AS (SELECT label_id, recorded_at, {_TARGET} FROM label_manifest),
limits AS (SELECT nullif({word_sql("taxonomy_group")}, 'unclassified') AS g, max_rows FROM contributor_limit),
ranked AS (
  SELECT label_id, g, max_rows, row_number() OVER (PARTITION BY g ORDER BY coalesce(t, 'Z'), recorded_at DESC NULLS LAST, label_id) AS place
  FROM labels LEFT JOIN limits USING (g))
"""

_P3_QUOTA = f"""RECURSIVE {_P3},
numbered AS (SELECT *, row_number() OVER () AS i, least(available, min_rows)::DOUBLE AS least_rows, coalesce(target_share, 0) * sample_rows AS share FROM report),
xs AS (SELECT list({{'a': available::DOUBLE, 'f': least_rows, 's': share}} ORDER BY i) AS xs, least(any_value(sample_rows), sum(available))::DOUBLE AS aim FROM numbered),
b AS (
  SELECT 0 AS step, false AS found, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + found::INT, found OR total >= aim OR hi >= 1e18, CASE WHEN found AND total < aim THEN pt ELSE lo END, CASE WHEN found THEN CASE WHEN total < aim THEN hi ELSE pt END WHEN total >= aim OR hi >= 1e18 THEN hi ELSE hi * 2 END
  FROM (SELECT b.*, aim, CASE WHEN found THEN (lo + hi) / 2 ELSE hi END AS pt, list_sum(list_transform(xs, lambda t: least(t.a, greatest(t.f, CASE WHEN found THEN (lo + hi) / 2 ELSE hi END * t.s)))) AS total FROM b, xs) WHERE step < 200),
taken AS (SELECT n.*, aim, least(n.available, greatest(least_rows, b.hi * share)) AS take FROM numbered n, xs, (SELECT hi FROM b ORDER BY step DESC LIMIT 1) b),
lower AS (SELECT *, floor(take + 1e-9)::BIGINT AS base, aim - sum(floor(take + 1e-9)) OVER () AS missing FROM taken),
quotas AS (SELECT *, base + (base < available AND row_number() OVER (ORDER BY (base < available) DESC, take - floor(take) DESC, i) <= missing)::BIGINT AS quota FROM lower)
"""
_RECORDS = f"""
seen AS (SELECT record_id, source_genome_id, {visible_sql("source_genome_id")} AS s, {visible_sql("assembly_accession")} AS t, {word_sql("target_label")} AS label FROM grouped_training_dataset),
rec AS (SELECT record_id, {genome_sql("s")} AS a, {genome_sql("t")} AS b, CASE WHEN regexp_matches(s, '[^\\s\\p{{Z}}]') THEN source_genome_id END AS text, label FROM seen),
held AS (SELECT record_id, a AS k FROM rec WHERE a IS NOT NULL UNION SELECT record_id, b FROM rec WHERE b IS NOT NULL),
c0 AS (SELECT record_id, record_id AS c FROM rec)"""
_ROUNDS = 16
# the least record of a set goes from records to their keys and back until all of a set have it
_SETS = _RECORDS + "".join(f""",
k{i} AS MATERIALIZED (SELECT k, min(c) AS c FROM held JOIN c{i - 1} USING (record_id) GROUP BY k),
c{i} AS MATERIALIZED (SELECT record_id, least(any_value(c{i - 1}.c), coalesce(min(k{i}.c), any_value(c{i - 1}.c))) AS c FROM c{i - 1} LEFT JOIN held USING (record_id) LEFT JOIN k{i} USING (k) GROUP BY record_id)""" for i in range(1, _ROUNDS + 1)) + f""",
members AS (SELECT rec.*, c AS first_record FROM rec JOIN c{_ROUNDS} USING (record_id))"""
_SPLITS = f"""RECURSIVE {_SETS},
sets AS (SELECT first_record, count(*) AS n, floor(least(count(*) FILTER (label = 'positive') / count(*)::DOUBLE * 5, 4))::INT AS stratum FROM members GROUP BY first_record),
sizes AS (SELECT stratum, n, count(*) AS c FROM sets GROUP BY ALL),
strata AS (SELECT stratum, sum(n * c)::DOUBLE AS total, row_number() OVER (ORDER BY max(n) DESC, stratum) AS turn FROM sizes GROUP BY stratum),
steps AS (SELECT stratum, n, c, total, row_number() OVER (ORDER BY turn, n DESC) AS step, row_number() OVER (PARTITION BY stratum ORDER BY n DESC) = 1 AS opens FROM sizes JOIN strata USING (stratum)),
dealt AS (
  SELECT 0::BIGINT AS step, 0 AS stratum, 0::BIGINT AS n, [0.0, 0.0, 0.0]::DOUBLE[] AS lack, [0, 0, 0]::BIGINT[] AS got
  UNION ALL
  SELECT step, stratum, n, list_transform(range(1, 4), lambda i: lack[i] - n * got[i]), got FROM (
    SELECT step, stratum, n, lack, list_transform(range(1, 4), lambda i: base[i] + list_contains(list_transform(list_sort(list_transform(range(1, 4), lambda j: {{'f': base[j] - exact[j], 'r': n * base[j] - room[j], 'j': j}}))[1:(c - list_sum(base))::BIGINT], lambda x: x.j), i)::BIGINT) AS got FROM (
      SELECT *, list_transform(exact, lambda x: floor(x)::BIGINT) AS base FROM (
        SELECT *, list_transform(room, lambda x: c * x / list_sum(room)) AS exact FROM (
          SELECT *, CASE WHEN list_sum(list_transform(lack, lambda x: greatest(x, 0.0))) > 0 THEN list_transform(lack, lambda x: greatest(x, 0.0)) ELSE [0.8, 0.1, 0.1]::DOUBLE[] END AS room FROM (
            SELECT s.step, s.stratum, s.n, s.c, CASE WHEN s.opens THEN [0.8::DOUBLE * s.total + d.lack[1], 0.1::DOUBLE * s.total + d.lack[2], 0.1::DOUBLE * s.total + d.lack[3]] ELSE d.lack END AS lack FROM dealt d JOIN steps s ON s.step = d.step + 1)))))),
placed AS (SELECT s.first_record, CASE WHEN place <= got[1] THEN 'train' WHEN place <= got[1] + got[2] THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY stratum, n ORDER BY md5('5|' || first_record), first_record) AS place FROM sets) s JOIN dealt d ON d.step > 0 AND d.stratum = s.stratum AND d.n = s.n)
"""
_P7 = """sizes AS (SELECT doc_id, coalesce(strlen(text), 0) AS n FROM documents), cap AS (SELECT max_tokens AS cap FROM size_limit WHERE limit_name = 'container')"""
_P8_SIZES = f"""
docs AS (SELECT {word_sql("source")} AS k, count(*) AS n_documents, sum(coalesce(strlen(text), 0))::BIGINT AS n FROM documents GROUP BY ALL),
spec AS (SELECT row_number() OVER () AS i, {word_sql("source_weight.source")} AS source, weight, max_repeats, total_tokens::DOUBLE AS total, coalesce(n, 0) AS n, coalesce(n_documents, 0) AS n_documents, (coalesce(n, 0) * max_repeats)::DOUBLE AS cap FROM source_weight LEFT JOIN docs ON k = {word_sql("source_weight.source")})"""


def _filled(weights: str) -> str:
    """CTEs with the scale and the sources at their cap when wanted weights (rows i, w of `weights`) are filled up to the total."""
    return f"""
ws AS (SELECT list({{'i': i, 'w': w, 'cap': cap, 's': n / (SELECT sum(n)::DOUBLE FROM spec)}} ORDER BY i) AS xs, any_value(total) AS total FROM spec JOIN {weights} USING (i)),
fill AS (
  SELECT 0 AS step, 1.0::DOUBLE AS scale, []::BIGINT[] AS capped, []::BIGINT[] AS latest
  UNION ALL
  SELECT step + 1, CASE WHEN len(now) > 0 AND rest > 0 THEN greatest(total - coalesce(list_sum(list_transform(list_filter(xs, lambda x: list_contains(every, x.i)), lambda x: x.cap)), 0), 0) / (rest * total) ELSE scale END, every, now FROM (
    SELECT *, coalesce(list_sum(list_transform(list_filter(xs, lambda x: x.w > 0 AND NOT list_contains(every, x.i)), lambda x: x.w)), 0) AS rest FROM (
      SELECT *, list_concat(capped, now) AS every FROM (
        SELECT fill.*, xs, total, list_transform(list_filter(xs, lambda x: x.w > 0 AND NOT list_contains(capped, x.i) AND scale * x.w * total > x.cap), lambda x: x.i) AS now FROM fill, ws WHERE step = 0 OR len(latest) > 0))) WHERE step < 100),
ended AS (SELECT scale, capped FROM fill ORDER BY step DESC LIMIT 1),
limits AS (SELECT latest AS limited FROM fill WHERE step = 1),
at_scale AS (SELECT f.step, prev.scale, unnest(f.latest) AS i FROM fill f JOIN fill prev ON prev.step = f.step - 1),
budgets AS (SELECT spec.*, w, list_contains(capped, i) AS at_cap, list_contains(limited, i) AS is_limited, CASE WHEN list_contains(capped, i) THEN cap ELSE ended.scale * w * total END AS budget,
  CASE WHEN list_contains(capped, i) THEN CASE WHEN n = 0 THEN 0.0 WHEN n / (SELECT sum(n)::DOUBLE FROM spec) >= w THEN 1.0 ELSE least(1.0, ln(cap / (a.scale * w * total)) / ln(n / (SELECT sum(n)::DOUBLE FROM spec) / w)) END ELSE 0.0 END AS exponent
  FROM spec JOIN {weights} USING (i) LEFT JOIN at_scale a USING (i), ended, limits)"""


# whole blocks, of the last one the documents that fit in its order, then the largest that fit into what is left
_REALISED = f"""
planned AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN at_cap THEN max_repeats ELSE floor(budget / n) END::BIGINT AS blocks FROM budgets),
lasts AS (SELECT *, floor(greatest(budget - blocks * n, 0))::BIGINT AS last FROM planned),
ordered AS (SELECT i, doc_id, coalesce(strlen(text), 0) AS size, last, sum(coalesce(strlen(text), 0)) OVER (PARTITION BY i ORDER BY substr(md5('13|' || blocks || '|' || doc_id), 1, 15), doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents JOIN lasts ON {word_sql("documents.source")} = lasts.source WHERE last > 0),
prefix AS (SELECT i, any_value(last) AS last, coalesce(max(running) FILTER (running <= last), 0) AS run FROM ordered GROUP BY i),
sizes AS (SELECT i, size, count(*) AS c FROM ordered JOIN prefix USING (i) WHERE running > prefix.last AND size > 0 AND size <= prefix.last - run GROUP BY ALL),
filled AS (SELECT i, list_reduce(list_prepend({{'size': 0::BIGINT, 'c': 0::BIGINT, 'left': (prefix.last - run)::BIGINT}}, list({{'size': size::BIGINT, 'c': c::BIGINT, 'left': 0::BIGINT}} ORDER BY size DESC)), lambda acc, x: {{'size': x.size, 'c': x.c, 'left': acc.left - x.size * least(x.c, acc.left // x.size)}}).left AS room_left FROM sizes JOIN prefix USING (i) GROUP BY i, prefix.last, run),
realised AS (SELECT lasts.*, (blocks * n + CASE WHEN lasts.last > 0 THEN coalesce(prefix.last - room_left, run) ELSE 0 END)::BIGINT AS mix_tokens FROM lasts LEFT JOIN prefix USING (i) LEFT JOIN filled USING (i))"""
_P8 = f"RECURSIVE {_P8_SIZES}, given AS (SELECT i, weight AS w FROM spec), {_filled('given')}"
_P8_TEMPERED = f"""RECURSIVE {_P8_SIZES},
shares AS (SELECT list({{'i': i, 's': n / (SELECT sum(n)::DOUBLE FROM spec), 'cap': cap}} ORDER BY i) AS xs, any_value(total) AS total, -sum(weight * ln(weight)) FILTER (weight > 0) AS aim, max(n) / (SELECT sum(n)::DOUBLE FROM spec) AS top FROM spec),
bisected AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN flat AND step > 1 THEN pt ELSE lo END, CASE WHEN step = 0 THEN CASE WHEN flat THEN hi ELSE 0.0 END WHEN step = 1 OR flat THEN hi ELSE pt END FROM (
    SELECT *, -list_sum(list_transform(w, lambda x: CASE WHEN x.w > 0 THEN x.w * ln(x.w) ELSE 0 END)) > aim OR len(list_filter(w, lambda x: x.w * total > x.cap * (1 + 1e-12))) > 0 AS flat FROM (
      SELECT *, list_transform(raw, lambda x: {{'w': x.r / list_sum(list_transform(raw, lambda y: y.r)), 'cap': x.cap}}) AS w FROM (
        SELECT bisected.*, aim, total, CASE step WHEN 0 THEN 0.0 WHEN 1 THEN hi ELSE (lo + hi) / 2 END AS pt, list_transform(xs, lambda x: {{'r': CASE WHEN x.s > 0 THEN (x.s / top) ** (CASE step WHEN 0 THEN 0.0 WHEN 1 THEN hi ELSE (lo + hi) / 2 END) ELSE 0 END, 'cap': x.cap}}) AS raw FROM bisected, shares))) WHERE step < 102),
powered AS (SELECT i, CASE WHEN n > 0 THEN (n / (SELECT sum(n)::DOUBLE FROM spec) / top) ** hi ELSE 0 END AS r FROM spec, shares, (SELECT hi FROM bisected ORDER BY step DESC LIMIT 1)),
tempered AS (SELECT i, r / (SELECT sum(r) FROM powered) AS w FROM powered), {_filled('tempered')}"""

SQL = {
    "p1_found": f"WITH {_P1} SELECT record_id FROM hits WHERE by_genome OR by_features",
    "p1_overlap_report": f"""WITH {_P1} SELECT role, genome, count(*) AS n_records, count(*) FILTER (by_genome) AS n_same_genome, count(*) FILTER (by_features) AS n_same_features
FROM hits WHERE by_genome OR by_features GROUP BY role, genome""",
    "p3_found": f"WITH {_P3} SELECT taxonomy_group, target_label, evidence_tier FROM report WHERE available < wanted",
    "p3_shortfalls": f"WITH {_P3} SELECT g AS taxonomy_group, l AS target_label, t AS evidence_tier, available, wanted, available < wanted AS exhausted FROM report",
    "p3_report": f"WITH {_P3_QUOTA} SELECT g AS taxonomy_group, l AS target_label, t AS evidence_tier, available, wanted, quota, quota AS drawn, available < wanted AS exhausted FROM quotas",
    "p3_sample": f"""WITH {_P3_QUOTA}, units AS (SELECT g, l, t, k, min(label_id) AS label_id FROM (SELECT label_id, {_TARGET}, nullif(lower(trim(assembly_accession, e' \\t\\n')), '') AS k FROM label_manifest) WHERE k IS NOT NULL GROUP BY ALL),
ranked AS (SELECT u.*, quota, row_number() OVER (PARTITION BY g, l, t ORDER BY substr(md5('7|' || g || '|' || l || '|' || t || '|' || k), 1, 15), k) AS place FROM units u JOIN quotas USING (g, l, t))
SELECT label_id, g AS taxonomy_group, l AS target_label, t AS evidence_tier FROM ranked WHERE place <= quota""",
    "p4_weighted_draw": f"""WITH {_P4}, drawn AS (SELECT labels.label_id, g, max_rows, -(ln(CASE t WHEN 'A' THEN 8.0::DOUBLE WHEN 'B' THEN 4.0 WHEN 'C' THEN 2.0 ELSE 1.0 END) - ln(-ln((('0x' || substr(md5('11|' || label_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE))) AS draw FROM labels LEFT JOIN limits USING (g)),
places AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY draw, label_id) AS place FROM drawn) SELECT label_id, g AS taxonomy_group FROM places WHERE max_rows IS NULL OR place <= max_rows""",
    "p4_found": f"WITH {_P4} SELECT label_id FROM ranked WHERE place > max_rows",
    "p4_kept_by_group": f"WITH {_P4} SELECT g AS taxonomy_group, count(*) FILTER (max_rows IS NULL OR place <= max_rows) AS n_kept, count(*) FILTER (place > max_rows) AS n_left_out FROM ranked GROUP BY g",
    "p5_found": f"""WITH {_SETS}, mixed AS (SELECT first_record FROM members GROUP BY 1 HAVING count(DISTINCT text) > 1) SELECT first_record, record_id FROM members JOIN mixed USING (first_record) WHERE record_id <> first_record""",
    "p5_component_sizes": f"WITH {_SETS}, s AS (SELECT first_record, count(*) AS n_records FROM members WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1) SELECT n_records, count(*) AS n_sets FROM s GROUP BY n_records",
    "p5_splits": f"WITH {_SPLITS} SELECT record_id, split FROM members JOIN placed USING (first_record)",
    "p5_split_report": f"WITH {_SPLITS}, counts AS (SELECT split, label, count(*) AS n_records FROM members JOIN placed USING (first_record) GROUP BY ALL) SELECT split, label, n_records, n_records / sum(n_records) OVER (PARTITION BY label)::DOUBLE AS label_share FROM counts",
    "p7_documents": f"WITH {_P7} SELECT doc_id, CASE WHEN n = 0 THEN 1 ELSE ceil(n / cap::DOUBLE) END::BIGINT AS n_pieces, n AS n_tokens, true AS all_fit FROM sizes, cap",
    "p7_fill": f"WITH {_P7} SELECT sum(n)::BIGINT AS n_tokens, ceil(sum(n) / any_value(cap)::DOUBLE)::BIGINT AS n_least, true AS none_overfull, true AS well_filled, true AS numbered_through FROM sizes, cap",
    "p8_report": f"""WITH {_P8}, {_REALISED} SELECT source, weight, round(exponent, 6) AS exponent, round(weight * total, 3) AS goal_tokens, n AS source_tokens, cap::BIGINT AS cap_tokens, round(budget, 3) AS budget_tokens, mix_tokens, round(mix_tokens / sum(mix_tokens) OVER ()::DOUBLE, 9) AS mix_share, cap < weight * total AS short FROM realised""",
    "p8_mix_blocks": f"""WITH {_P8}, b AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN at_cap THEN max_repeats ELSE floor(budget / n) END::BIGINT AS blocks FROM budgets)
SELECT source, unnest(range(0, blocks))::INT AS block, n_documents, n AS n_tokens, 0::BIGINT AS n_repeated FROM b""",
    "p8_tempered_report": f"WITH {_P8_TEMPERED} SELECT source, round(w, 6) AS weight, n AS source_tokens, cap::BIGINT AS cap_tokens, round(budget, 3) AS budget_tokens, true AS within_budget FROM budgets",
    "p9_pieces": """WITH c AS (SELECT doc_id, text, CASE WHEN list_max(list_transform(string_split_regex(text, '[ \\t\\n\\r.!?;。]'), lambda x: strlen(x))) > max_tokens THEN 'forced' ELSE 'natural' END AS cut FROM documents, (SELECT max_tokens FROM size_limit WHERE limit_name = 'piece') WHERE strlen(text) > max_tokens)
SELECT doc_id, cut, md5(text) AS text_md5, strlen(text) AS n_tokens, true AS all_fit, true AS all_share FROM c""",
    "p9_sizes": """WITH c AS (SELECT strlen(text) AS n, CASE WHEN list_max(list_transform(string_split_regex(text, '[ \\t\\n\\r.!?;。]'), lambda x: strlen(x))) > max_tokens THEN 'forced' ELSE 'natural' END AS cut FROM documents, (SELECT max_tokens FROM size_limit WHERE limit_name = 'piece') WHERE strlen(text) > max_tokens)
SELECT cut, count(*) AS n_documents, sum(n)::BIGINT AS n_tokens, true AS all_fit FROM c GROUP BY cut""",
    "p7_found": "SELECT doc_id FROM documents WHERE strlen(text) > (SELECT max_tokens FROM size_limit WHERE limit_name = 'container')",
    "p8_found": f"""WITH sizes AS (SELECT {word_sql("source")} AS k, sum(strlen(text)) AS n FROM documents GROUP BY ALL)
SELECT source FROM source_weight LEFT JOIN sizes ON {word_sql("source_weight.source")} = k WHERE coalesce(n, 0) * max_repeats < weight * total_tokens""",
    "p9_found": """SELECT doc_id, CASE WHEN list_max(list_transform(string_split_regex(text, '[ \\t\\n\\r.!?;。]'), lambda x: strlen(x))) > max_tokens THEN 'forced' ELSE 'natural' END AS cut
FROM documents, (SELECT max_tokens FROM size_limit WHERE limit_name = 'piece') WHERE strlen(text) > max_tokens""",
}
