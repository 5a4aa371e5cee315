"""What SQL can express of the results: op1's counts, op6's hosts and rules, op7's digests, in DuckDB on the same tables."""

import duckdb
import pytest

from sparkloom.llm import queries, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_op1_counts(spark, con):
    want = con.sql(r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) > 4), k AS (SELECT doc_id, i, w[i:i + 4] AS gram FROM g),
        p AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM k) WHERE c > 1), q AS (SELECT DISTINCT doc_id, i + o AS at FROM p, (SELECT unnest(range(0, 5)) AS o)), n AS (SELECT doc_id, count(*) AS n FROM q GROUP BY 1)
        SELECT d.doc_id, len(w), length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')), length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')), len(lines) - len(list_distinct(lines)), coalesce(n.n, 0)
        FROM d JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)""").fetchall()
    got = queries.op1_quality_rules(spark, SF).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)


def test_op6_hosts_and_rules(spark, con):
    longest = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for h, p, _ in longest)
    want = con.sql(rf"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages), a AS (SELECT page_id, CASE WHEN contains(u, '://') THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM u),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
        SELECT page_id, host, path, CASE {fits} END AS rule FROM h""").fetchall()
    got = queries.op6_url_filter(spark, SF).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=repr) == sorted(want, key=repr)
    verdict = {h + p: v for h, p, v in url_filter.RULES}
    assert all(r.verdict == verdict[r.rule] for r in got if r.rule)


def test_op7_digests(spark, con):
    own = "SELECT -7 AS conv_id, 0 AS turn, 'user' AS role, $x AS text UNION ALL SELECT -7, 1, 'assistant', $x"
    want = con.execute(f"""
        WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL {own})
        SELECT conv_id, count(*), sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)), coalesce(sum(length(text)) FILTER (role = 'assistant'), 0), sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) FROM c GROUP BY 1""", {"x": queries.CONFLICT}).fetchall()
    got = queries.op7_chat_format(spark, SF).collect()
    assert sorted((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got) == sorted((a, b, c, int(d), e) for a, b, c, d, e in want)
