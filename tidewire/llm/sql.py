"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def _sainte_lague(name: str, rows: str, group: str, key: str, share: str, seats: str) -> str:
    """Common table expressions that give ``rows`` a quota by highest quotients, in a window round the exact share."""
    over = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    part = f"PARTITION BY {group} " if group else ""
    keys = ", ".join(filter(None, [group, key]))
    return f"""{name}_b AS (SELECT *, greatest(0, floor(CASE WHEN sum({share}) {over} > 0 THEN {seats} * {share} / sum({share}) {over} ELSE 0 END) - 2)::BIGINT AS base FROM {rows}),
 {name}_l AS (SELECT *, {seats} - sum(base) {over} AS remain FROM {name}_b),
 {name}_k AS (SELECT {keys}, remain, row_number() OVER ({part}ORDER BY {share} / (2 * (base + j) + 1) DESC, {key}, j) AS place FROM {name}_l, range(7) g(j) WHERE {share} > 0),
 {name}_w AS (SELECT {keys}, count(*) AS won FROM {name}_k WHERE place <= remain GROUP BY ALL),
 {name} AS (SELECT l.*, base + coalesce(won, 0) AS quota FROM {name}_l l LEFT JOIN {name}_w USING ({keys}))"""


OP3 = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS ord FROM documents),
 s1 AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1)),
 s2 AS (SELECT *, ([5, 2, 1])[(nth - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS everything FROM s1),
 s3 AS (SELECT *, most / weight AS ratio FROM s2),
 s4 AS (SELECT *, (everything - coalesce(sum(most) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3),
 s5 AS (SELECT *, CASE WHEN level < ratio THEN max(CASE WHEN level < ratio THEN level END) OVER () * weight ELSE most END AS target FROM s4),
 s6 AS (SELECT *, greatest(1, least(1024, coalesce(floor(min(CASE WHEN target > 0 THEN target END) OVER () / 64), 1)))::BIGINT AS block FROM s5),
 s7 AS (SELECT *, round(sum(target) OVER () / block)::BIGINT AS seats FROM s6),
 {_sainte_lague('src', 's7', '', 'nth', 'target', 'seats')},
 p AS (SELECT d.*, src.nth, src.source_size, src.target, src.block, src.quota AS source_quota, ('0x' || substr(ord, 1, 8))::BIGINT % greatest(1, ceil(src.source_size / 262144.0))::BIGINT AS shard FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
 h0 AS (SELECT nth, shard, shard // 1024 AS grp, sum(size)::DOUBLE AS words, any_value(source_quota) AS source_quota, any_value(block) AS block FROM p GROUP BY 1, 2),
 g0 AS (SELECT nth, grp, sum(words) AS words, any_value(source_quota) AS source_quota FROM h0 GROUP BY 1, 2),
 {_sainte_lague('gr', 'g0', 'nth', 'grp', 'words', 'source_quota')},
 h1 AS (SELECT h0.*, gr.quota AS group_quota FROM h0 JOIN gr ON h0.nth = gr.nth AND h0.grp = gr.grp),
 {_sainte_lague('sh', 'h1', 'nth, grp', 'shard', 'words', 'group_quota')},
 h2 AS (SELECT nth, shard, words::BIGINT AS words, block, least(quota * block, (2 * words)::BIGINT)::BIGINT AS take, ('0x' || substr(md5('17:block:' || nth || ':' || shard), 1, 8))::BIGINT AS draw FROM sh),
 h3 AS (SELECT *, CASE WHEN words > 0 THEN take // words ELSE 0 END AS rounds, (draw % greatest(1, ceil(words / block::DOUBLE))::BIGINT) * block AS first FROM h2),
 r AS (SELECT p.*, h3.words, h3.rounds, h3.first, h3.first + h3.take - h3.rounds * h3.words AS stop, sum(size) OVER (PARTITION BY p.nth, p.shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM p JOIN h3 ON p.nth = h3.nth AND p.shard = h3.shard)
 SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(e, least(stop, words)) - greatest(e - size, first)) + greatest(0, least(e, greatest(0, stop - words)) - greatest(e - size, 0)))::BIGINT AS taken FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": OP3}
