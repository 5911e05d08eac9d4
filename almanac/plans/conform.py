"""Publisher reshapes, cleaning and the file gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import casts
from almanac.operators import grid, profile, quality as Q, reshape as R
from almanac.plans import layouts as L
from almanac.plans.catalog import query
from almanac.plans.fixtures import Tables

FILE_SQL = "CAST(report_id * 100 + year - 1990 AS INTEGER)"


# --- reshapes: the oracle is the facts the files were made of ---------------------------


@query(
    "reshape_nested_json",
    f"""SELECT {FILE_SQL} AS file_id, location_code, indicator_code,
        CASE WHEN indicator_code <> '5-LOW' THEN indicator_name END AS indicator_name, year,
        CASE WHEN location_code <> 'NAA' THEN value END AS value FROM star""",
    ["star"],
)
def reshape_nested_json(t: Tables):
    return R.reshape_nested_json(L.nested_json(t))


@query(
    "reshape_wide_unnamed",
    f"""SELECT {FILE_SQL} AS file_id, location_code, indicator_code, indicator_code AS indicator_name, year, value
        FROM star WHERE location_code <> 'NBA' AND NOT (location_code = 'NCC' AND indicator_code = '5-LOW')""",
    ["star"],
)
def reshape_wide_unnamed(t: Tables):
    return R.reshape_wide_unnamed(L.wide_unnamed(t))


@query(
    "unpivot_generic",
    f"""SELECT {FILE_SQL} AS file_id, location_code AS iso, p AS title,
        max(CASE WHEN indicator_code = p AND NOT (location_code = 'NCC' AND p = '5-LOW') THEN value END) AS value
        FROM star, (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS p)
        GROUP BY ALL""",
    ["star"],
)
def unpivot_generic(t: Tables):
    wide = L.wide_unnamed(t).withColumn("iso", F.upper("`Unnamed: 1`"))
    return R.unpivot_generic(wide, ["file_id", "iso"], L.PRIORITIES)


@query(
    "reshape_two_header_rows",
    f"""SELECT {FILE_SQL} AS file_id, location_code, indicator_code,
        CASE WHEN indicator_code = '4-NOT SPECIFIED' THEN indicator_code || '.score' ELSE indicator_name END
          AS indicator_name, 2025 AS year, value FROM star WHERE location_code <> 'NAB'""",
    ["star"],
)
def reshape_two_header_rows(t: Tables):
    return R.reshape_two_header_rows(L.two_header_rows(t))


@query(
    "reshape_country_names",
    f"""SELECT {FILE_SQL} AS file_id, location_code, indicator_code, indicator_code AS indicator_name,
        2026 AS year, value FROM star WHERE location_name NOT IN ('NATION_5', 'NATION_6')""",
    ["star"],
)
def reshape_country_names(t: Tables):
    return R.reshape_country_names(L.country_names(t), t.dim_location.select("name", "location_code"))


@query(
    "reshape_offset_header",
    f"""SELECT {FILE_SQL} AS file_id, location_code, indicator_code, indicator_code AS indicator_name, year, value
        FROM star WHERE location_code <> 'NAC'""",
    ["star"],
)
def reshape_offset_header(t: Tables):
    return R.reshape_offset_header(L.offset_header(t))


@query(
    "reshape_transposed",
    f"""SELECT file_id, location_code, indicator_code, indicator_name, 2024 AS year, value
        FROM (SELECT {FILE_SQL} AS file_id, * FROM star) WHERE file_id % 17 <> 0 AND file_id % 19 <> 0""",
    ["star"],
)
def reshape_transposed(t: Tables):
    return R.reshape_transposed(L.transposed(t))


@query(
    "transposed_errors",
    f"""SELECT DISTINCT file_id, CASE WHEN file_id % 17 = 0
          THEN 'Linha de cabeçalho com ''Attribute'' não encontrada nas primeiras 10 linhas.'
          ELSE 'Nenhuma linha com Attribute=''Score'' encontrada.' END AS error
        FROM (SELECT {FILE_SQL} AS file_id FROM star) WHERE file_id % 17 = 0 OR file_id % 19 = 0""",
    ["star"],
)
def transposed_errors(t: Tables):
    return R.transposed_errors(L.transposed(t))


@query(
    "reshape_regex_melt",
    """SELECT report_id AS file_id, location_code, indicator_code, indicator_code AS indicator_name, year, value
       FROM star""",
    ["star"],
)
def reshape_regex_melt(t: Tables):
    return R.reshape_regex_melt(L.raw_year_columns(t))


@query(
    "header_promote",
    f"""SELECT file_id, 'Sheet1' AS sheet, CAST(4 + place AS INTEGER) AS r, CAST(c AS INTEGER) AS c, title, text FROM (
        SELECT file_id, place, 4 + slot AS c, ' ' || indicator_code || ' ' AS title, CAST(value AS VARCHAR) AS text FROM rows
        UNION ALL SELECT DISTINCT file_id, place, 0, 'Year', year || '.0' FROM rows
        UNION ALL SELECT DISTINCT file_id, place, 2, 'ISO Code 3', ' ' || location_code FROM rows WHERE location_code <> 'NAC'
        UNION ALL SELECT DISTINCT file_id, place, 3, 'Countries', location_name FROM rows
        UNION ALL SELECT DISTINCT file_id, place, 4, 'Rank', '12' FROM rows
        UNION ALL SELECT DISTINCT file_id, place, 10, '1-URGENT Rank', '3' FROM rows)""",
    ["star"],
    {
        "rows": f"""SELECT *, {FILE_SQL} AS file_id, CAST(indicator_code[1] AS INTEGER) AS slot,
            (ascii(location_code[2]) - 65) * 5 + ascii(location_code[3]) - 64 AS place FROM star"""
    },
)
def header_promote(t: Tables):
    return grid.header_promote(L.offset_header(t), R.OFFSET_HEADER.header_row)


@query(
    "profile_tabular",
    """SELECT CAST(0 AS INTEGER) AS position, 'location_code' AS column_name, count(*) AS n_rows,
         count(*) - count(location_code) AS n_null, min(location_code) AS min_text, max(location_code) AS max_text FROM dirty
       UNION ALL SELECT 1, 'indicator_name', count(*), count(*) - count(indicator_name), min(indicator_name), max(indicator_name) FROM dirty
       UNION ALL SELECT 2, 'year', count(*), count(*) - count(year), min(year), max(year) FROM dirty
       UNION ALL SELECT 3, 'value', count(*), count(*) - count(value), min(value), max(value) FROM dirty""",
    ["dirty"],
)
def profile_tabular(t: Tables):
    return profile.profile_tabular(t.dirty.select("location_code", "indicator_name", "year", "value"))


@query(
    "profile_json_shape",
    f"""SELECT file_id, 0 AS depth, '$' AS path, 2 AS n_keys, 'indicators, values' AS keys FROM files
        UNION ALL SELECT file_id, 1, '$.indicators', n, k FROM labels
        UNION ALL SELECT file_id, 1, '$.values', v_n, v FROM labels
        UNION ALL SELECT file_id, 2, '$.indicators.' || indicator_code,
          CASE WHEN indicator_code = '5-LOW' THEN 0 ELSE 1 END,
          CASE WHEN indicator_code = '5-LOW' THEN '' ELSE 'label' END FROM codes
        UNION ALL SELECT file_id, 2, '$.values.' || indicator_code, CAST(len(p) AS INTEGER),
          CASE WHEN len(p) <= 4 THEN array_to_string(p, ', ')
               WHEN len(p) <= 6 THEN array_to_string(p, ', ')
               ELSE array_to_string(p[1:4], ', ') || ', ... (' || (len(p) - 6) || ' more keys) ..., '
                    || array_to_string(p[-2:], ', ') END FROM places""",
    ["star"],
    {
        "rows": f"SELECT *, {FILE_SQL} AS file_id FROM star",
        "files": "SELECT DISTINCT file_id FROM rows",
        "codes": "SELECT DISTINCT file_id, indicator_code FROM rows",
        "labels": """SELECT file_id, CAST(len(l) AS INTEGER) AS n,
            CASE WHEN len(l) <= 6 THEN array_to_string(l, ', ') END AS k,
            CAST(len(l) + 1 AS INTEGER) AS v_n, array_to_string(list_append(l, 'GONE'), ', ') AS v
            FROM (SELECT file_id, list_sort(list(indicator_code)) AS l FROM codes GROUP BY ALL)""",
        "places": """SELECT file_id, indicator_code, list_sort(list_append(list(location_code), 'ADVEC')) AS p
            FROM rows GROUP BY ALL""",
    },
)
def profile_json_shape(t: Tables):
    return profile.profile_json_shape(L.nested_json(t))


# --- cleaning and gates ------------------------------------------------------------------


@query(
    "clean_long",
    """SELECT file_id, location_code, indicator_code, coalesce(indicator_name, indicator_code) AS indicator_name,
         year, value FROM (SELECT DISTINCT file_id, location_code, indicator_code, indicator_name, year, value FROM dirty)
       WHERE location_code IS NOT NULL AND indicator_code IS NOT NULL AND year IS NOT NULL AND value IS NOT NULL""",
    ["dirty"],
)
def clean_long(t: Tables):
    return Q.clean_long(R.conform(t.dirty))


@query(
    "iso3_filter",
    "SELECT file_id, ord, copy, location_code FROM dirty WHERE regexp_full_match(location_code, '[A-Z]{3}')",
    ["dirty"],
)
def iso3_filter(t: Tables):
    rows = t.dirty.where(casts.is_iso3(F.col("location_code")))
    return rows.select("file_id", "ord", F.col("copy").cast("long").alias("copy"), "location_code")


@query(
    "null_counts",
    """SELECT file_id, count(*) - count(location_code) AS null_location_code,
       count(*) - count(indicator_code) AS null_indicator_code, count(*) - count(year) AS null_year
       FROM dirty GROUP BY ALL""",
    ["dirty"],
)
def null_counts(t: Tables):
    return Q.null_counts(t.dirty, ["location_code", "indicator_code", "year"])


@query(
    "sample_head",
    """SELECT file_id, ord, location_code, CAST(n AS INTEGER) AS position FROM (SELECT *, row_number() OVER (
       PARTITION BY file_id ORDER BY ord, copy) AS n FROM dirty WHERE location_code IS NOT NULL) WHERE n <= 30""",
    ["dirty"],
)
def sample_head(t: Tables):
    return Q.sample_head(t.dirty, "location_code", ["ord", "copy"]).select(
        "file_id", "ord", "location_code", "position"
    )


_SAMPLED = {
    "sampled": """SELECT file_id, count(*) AS n_sampled, count(*) FILTER (WHERE good) AS n_iso3,
        (list(location_code ORDER BY n) FILTER (WHERE NOT good))[1:5] AS bad FROM (
          SELECT *, regexp_full_match(location_code, '[A-Z]{3}') AS good, row_number() OVER (
            PARTITION BY file_id ORDER BY ord, copy) AS n FROM dirty WHERE location_code IS NOT NULL)
        WHERE n <= 30 GROUP BY ALL""",
    "counted": """SELECT file_id, count(*) AS n_rows, count(*) - count(location_code) AS n_loc,
        count(*) - count(indicator_code) AS n_ind, count(*) - count(year) AS n_year,
        count(*) - count(TRY_CAST(year AS DOUBLE)) AS bad_years, count(TRY_CAST(value AS DOUBLE)) AS good_values
        FROM dirty GROUP BY ALL""",
}


@query(
    "dq_gate",
    """SELECT file_id, message = '' AS ok, message FROM (SELECT file_id, array_to_string([x FOR x IN [
         CASE WHEN n_rows IS NULL THEN 'Ficheiro Parquet está vazio' END,
         CASE WHEN n_loc > 0 THEN '''location_code'' tem ' || n_loc || ' valor(es) nulo(s)' END,
         CASE WHEN n_ind > 0 THEN '''indicator_code'' tem ' || n_ind || ' valor(es) nulo(s)' END,
         CASE WHEN n_year > 0 THEN '''year'' tem ' || n_year || ' valor(es) nulo(s)' END,
         CASE WHEN n_iso3 < greatest(1, n_sampled * 0.8) THEN
           '''location_code'' não contém códigos ISO3 válidos (ex: ''AFG'',''PRT''). Encontrado: ['''
           || array_to_string(bad, ''', ''') || ''']' END,
         CASE WHEN bad_years > 0 THEN '''year'' tem ' || bad_years || ' valor(es) não numérico(s)' END,
         CASE WHEN good_values = 0 THEN '''value'' não tem nenhum valor numérico válido' END
       ] IF x IS NOT NULL], '; ') AS message
       FROM (SELECT DISTINCT CAST(file_id AS INTEGER) AS file_id FROM
              (SELECT file_id FROM op_data UNION ALL SELECT file_id + 50 FROM op_data))
         LEFT JOIN counted USING (file_id) LEFT JOIN sampled USING (file_id))""",
    ["dirty", "op_data"],
    _SAMPLED,
)
def dq_gate(t: Tables):
    files = t.op_data.select("file_id")
    never_written = files.select((F.col("file_id") + 50).cast("int").alias("file_id"))
    return Q.dq_gate(t.dirty, ["ord", "copy"], files.union(never_written).distinct())


@query(
    "extractor_contract",
    """SELECT file_id, NOT (n_iso3 < greatest(1, n_sampled * 0.4)) AS valid,
         CASE WHEN n_iso3 < greatest(1, n_sampled * 0.4) THEN
         'location_code must be ISO3 codes (3 uppercase letters, e.g. ''AFG'', ''USA'', ''PRT''). Got: ['''
         || array_to_string(bad, ''', ''') || '''].'
         || ' Identify the column whose values are exactly 3 uppercase letters and use it as location_code.' END AS error
       FROM counted LEFT JOIN sampled USING (file_id)""",
    ["dirty"],
    _SAMPLED,
)
def extractor_contract(t: Tables):
    return Q.extractor_contract(t.dirty, ["ord", "copy"])


@query(
    "contract_preview",
    """SELECT file_id, location_code, indicator_code, year, value, CAST(n AS INTEGER) AS position FROM (
       SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ord, copy) AS n FROM dirty) WHERE n <= 3""",
    ["dirty"],
)
def contract_preview(t: Tables):
    return Q.contract_preview(t.dirty, ["ord", "copy"]).select(
        "file_id", "location_code", "indicator_code", "year", "value", "position"
    )


@query(
    "to_number_coerce",
    "SELECT file_id, ord, TRY_CAST(value AS DOUBLE) AS number FROM dirty",
    ["dirty"],
)
def to_number_coerce(t: Tables):
    return t.dirty.select("file_id", "ord", casts.to_number(F.col("value")).alias("number"))


@query(
    "year_from_float",
    """SELECT file_id, ord, CAST(TRY_CAST(year AS INTEGER) AS INTEGER) AS year FROM dirty""",
    ["dirty"],
)
def year_from_float(t: Tables):
    padded = F.concat(F.col("year"), F.lit(".75"))
    return t.dirty.select("file_id", "ord", casts.year_from_float(padded).alias("year"))


@query(
    "nan_is_null",
    """SELECT event_type, count(*) AS n_rows, count(CASE WHEN event_id % 7 <> 0 THEN 1 END) AS n_values,
       round(sum(CASE WHEN event_id % 7 <> 0 THEN value END), 2) AS total FROM events GROUP BY ALL""",
)
def nan_is_null(t: Tables):
    holed = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    value = casts.nan_to_null(holed)
    return (
        t.raw("events")
        .groupBy("event_type")
        .agg(F.count("*").alias("n_rows"), F.count(value).alias("n_values"), F.round(F.sum(value), 2).alias("total"))
    )


@query(
    "extractor_registry",
    """SELECT indicator_code, count(*) AS n_rows, round(sum(value), 2) AS total FROM star GROUP BY ALL""",
    ["star"],
)
def extractor_registry(t: Tables):
    """A layout looked up under its publisher name, then cleaned."""
    rows = Q.clean_long(R.conform(R.extractor("epi")(L.raw_year_columns(t))))
    return rows.groupBy("indicator_code").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "resolve_extractor",
    """SELECT d.file_id, d.report_id, r.source_code,
         CASE WHEN ai_extract_function = 'manual' THEN extract_function
              ELSE coalesce(ai_extract_function, extract_function) END AS extractor,
         CASE WHEN ai_extract_function = 'manual' AND extract_function IS NULL
                THEN 'Sem mapeamento manual para ''' || r.source_code || '''. Configure um mapeamento no Painel de Controlo.'
              WHEN ai_extract_function IS NULL AND extract_function IS NULL
                THEN 'AI não conseguiu gerar função para ''' || r.source_code || '''. Configure um mapeamento manual no Painel de Controlo.'
              WHEN ai_extract_function = 'valores_1a2b'
                THEN 'Função ''valores_1a2b'' (mapeada para ''' || r.source_code || ''') não encontrada em EXTRACT_FUNCTIONS'
              END AS reason
       FROM op_data d JOIN op_report r USING (report_id) LEFT JOIN mapping m ON m.source_code = r.source_code
       WHERE d.pipeline_status = 'bronze'""",
    ["op_data", "op_report", "mapping"],
)
def resolve_extractor(t: Tables):
    files = (
        t.op_data.where(F.col("pipeline_status") == "bronze")
        .join(t.op_report.select("report_id", "source_code"), "report_id")
        .select("file_id", "report_id", "source_code")
    )
    return R.resolve_extractor(files, t.mapping)
