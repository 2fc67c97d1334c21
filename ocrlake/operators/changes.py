"""Rebuilding a table from a feed of inserts, updates and deletes, by SQL only.

Column-wise last writer wins: for each field the value of the latest change that set it, where only changes after the
latest delete (or whole-row replacement) of the key count. Everything is one aggregate per key with map-side combine,
so order and number of deliveries do not matter and a key with very many changes is no special case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

UPSERT, DELETE, REPLACE = "UPSERT", "DELETE", "REPLACE"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def apply_changes(feed: DataFrame, keys: Sequence[str], seq: str, op: str, fields: Sequence[str]) -> DataFrame:
    """Current rows (``keys`` + ``fields``) after all changes of ``feed`` in order of ``seq``.

    ``op`` is UPSERT (sets the fields that are not null), REPLACE (sets all fields, nulls too) or DELETE; other values
    and rows with a null sequence change nothing. Repeated deliveries of a change have no effect. Two changes with the
    same key and sequence: a delete goes first, then a replacement, then upserts; among equals the greatest value of a
    field wins. Null keys are keys of their own. Other columns of ``feed`` are ignored, whatever their names.
    """
    # columns get names of their own first, so that those of the feed can be any
    own = feed.selectExpr(
        f"{_quoted(seq)} AS s",
        f"{_quoted(op)} AS o",
        *(f"{_quoted(k)} AS k{i}" for i, k in enumerate(keys)),
        *(f"{_quoted(f)} AS f{i}" for i, f in enumerate(fields)),
    )
    key_list = ", ".join(f"k{i}" for i in range(len(keys)))
    # rank breaks ties of one sequence number: delete 0, replacement 1, upsert 2
    rank = f"CASE o WHEN '{DELETE}' THEN 0 WHEN '{REPLACE}' THEN 1 ELSE 2 END"
    # max of struct(sequence, value) is max_by(value, sequence) with a defined tie
    sets = "".join(f", max(named_struct('at', at, 'v', f{i})) FILTER (WHERE o = '{REPLACE}' OR (o = '{UPSERT}' AND f{i} IS NOT NULL)) AS w{i}" for i in range(len(fields)))
    picks = "".join(f", CASE WHEN w{i}.at >= bottom THEN w{i}.v END AS f{i}" for i in range(len(fields)))
    merged = feed.sparkSession.sql(
        f"""
        WITH changes AS (
          SELECT *, named_struct('s', s, 'r', {rank}) AS at FROM {{feed}}
          WHERE s IS NOT NULL AND o IN ('{UPSERT}', '{REPLACE}', '{DELETE}')
        ), merged AS (
          SELECT {key_list},
                 max(at) FILTER (WHERE o = '{DELETE}') AS gone,
                 max(at) FILTER (WHERE o <> '{DELETE}') AS alive,
                 coalesce(max(at) FILTER (WHERE o <> '{UPSERT}'), named_struct('s', NULL, 'r', NULL)) AS bottom
                 {sets}
          FROM changes GROUP BY {key_list}
        )
        SELECT {key_list}{picks} FROM merged WHERE alive IS NOT NULL AND (gone IS NULL OR alive > gone)
        """,
        feed=own,
    )
    return merged.toDF(*keys, *fields)


#: Index jobs as changes. A key is KIND:folder:path[:hash]; the path may hold colons, the hash never does. Parts are cut
#: out at the positions of colons. Each step names the one before it once or twice only, as steps are put into each other.
_JOB_CHANGES = r"""
  SELECT seq, op, folder_id, content_hash,
         CASE WHEN substring(p, 2, 1) = ':' AND upper(left(p, 1)) BETWEEN 'A' AND 'Z' THEN concat(upper(left(p, 1)), substring(p, 2)) ELSE p END AS path
  FROM (
    SELECT seq, op, folder_id, content_hash,
           CASE WHEN startswith(s, r'\\?\UNC\') THEN concat(r'\\', substring(s, 9)) WHEN startswith(s, r'\\?\') THEN substring(s, 5) ELSE s END AS p
    FROM (
      SELECT seq, op, coalesce(folder_id, try_cast(folder AS BIGINT)) AS folder_id, CASE WHEN op = 'REPLACE' THEN last END AS content_hash,
             translate(CASE WHEN op = 'REPLACE' AND length(rest) > length(last) + 1 THEN left(rest, length(rest) - length(last) - 1)
                            WHEN op = 'DELETE' AND rest <> '' THEN rest ELSE path END, '/', '\\') AS s
      FROM (
        SELECT id AS seq, CASE kind WHEN 'UPSERT_SCREENSHOT' THEN 'REPLACE' ELSE 'DELETE' END AS op, folder_id, path,
               CASE WHEN b > 0 THEN substring(dedupe_key, b + 1) END AS rest,
               CASE WHEN b > 0 THEN split_part(dedupe_key, ':', 2) END AS folder,
               CASE WHEN contains(dedupe_key, ':') THEN substring_index(dedupe_key, ':', -1) ELSE '' END AS last
        FROM (SELECT *, CASE WHEN contains(dedupe_key, ':') THEN locate(':', dedupe_key, locate(':', dedupe_key) + 1) ELSE 0 END AS b
              FROM (SELECT id, folder_id, path, dedupe_key, upper(trim(BOTH ' \t\r\n' FROM job_type)) AS kind FROM {jobs})
              WHERE kind IN ('UPSERT_SCREENSHOT', 'DELETE_SCREENSHOT'))
      )
    )
  )
"""


def job_changes(spark: SparkSession, jobs: DataFrame) -> DataFrame:
    """Index jobs as a change feed: seq, op, folder_id, path in plain form, content_hash ('' where the key has none).

    The path comes from the dedupe key, else from the path column. Jobs of other types are left out, as are rows
    without any path.
    """
    return spark.sql(f"SELECT * FROM ({_JOB_CHANGES}) WHERE path IS NOT NULL AND path <> '' AND folder_id IS NOT NULL", jobs=jobs)


def current_files(spark: SparkSession, jobs: DataFrame) -> DataFrame:
    """Files that exist after all jobs in order of id: folder_id, path, content_hash."""
    return apply_changes(job_changes(spark, jobs), ["folder_id", "path"], "seq", "op", ["content_hash"])
