"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import quality
from .decontamination import decontaminate
from .exchange import checkpointed
from .language_id import held_out, identify, train
from .line_dedup import line_dedup
from .near_dedup import near_duplicates
from .secret_scan import BASE, KINDS, OWNED, scan_secrets
from .source_mixing import mix_sources
from .spelling import corpus_words, spelling_variants
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .url_filter import domains_of, filter_urls, host_of
from .vector_codes import codebook_text, compress, with_label_error
from .vector_search import nearest

QUERIES: dict = {}
ORACLE: dict = {}
c = F.col


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_substring_dedup", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
    repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (s)),
    words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT words.doc_id, count(g.p) AS n_removed, string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE g.p IS NULL) AS t
             FROM words LEFT JOIN gone g ON g.doc_id = words.doc_id AND g.p = words.p GROUP BY words.doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)""")
def op1_substring_dedup(spark, sf_dir):
    found = substring_dedup(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_line_dedup", r"""
    WITH lines AS (
        SELECT doc_id, n, lines[n] AS line,
               translate(regexp_replace(lines[n], '^[ \t-\r]+|[ \t-\r]+$', '', 'g'),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
    frequent AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
    FROM lines LEFT JOIN frequent f USING (key) GROUP BY doc_id""")
def op6_line_dedup(spark, sf_dir):
    found = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_TOKENS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"""


@query("op2_decontamination", f"""
    WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TOKENS} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
           FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                 FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
    hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
    covered AS (SELECT doc_id, count(*) AS n_hit
                FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op2_decontamination(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    models = train(docs, teach=~held_out("doc_id"))
    row = docs.select(F.struct("doc_id", held_out("doc_id").alias("held_out")).alias("row"), "text")
    return identify(row, models, "row").select("row.*", "lang_pred", "score", "rejected")


@query("op9_near_dedup", r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    links AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
        JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
    reach AS (
        SELECT doc_id AS x, doc_id AS y FROM documents
        UNION SELECT reach.x, links.b FROM reach JOIN links ON links.a = reach.y),
    least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM least LEFT JOIN sizes USING (doc_id)""")
def op9_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=5, percent=75)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_same").cast("int")))).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query("op10_source_mixing")
def op10_source_mixing(spark, sf_dir):
    found = mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2)
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def _sql_matches(kind: str, nr: int, pattern: str, least: int) -> str:
    whole = "(?s)(.*?)(" + pattern.replace("'", "''") + ")"
    return (f"SELECT doc_id, owner, repo, '{kind}' AS kind, {nr} AS nr, {least} AS least, "
            + ", ".join(f"regexp_extract_all(text, '{whole}', {i}) AS m{i}" for i in (1, 2, 3)) + " FROM texts")


_RANDOM = "v ~ '.*[A-Z].*' AND v ~ '.*[a-z].*' AND v ~ '.*[0-9].*' AND 3 * len(list_distinct(string_split(v, ''))) >= length(v)"


@query("op8_secret_scan", f"""
    WITH texts AS (SELECT doc_id, source AS owner, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS text FROM documents),
    matches AS ({" UNION ALL ".join(_sql_matches(k, i, p, n) for i, (k, p, n) in enumerate((*BASE, OWNED)))}),
    single AS (
        SELECT * EXCLUDE (m1, m2, m3), unnest(m1) AS b, unnest(m2) AS f, unnest(m3) AS v, unnest(range(len(m1))) AS i FROM matches),
    placed AS (
        SELECT *, sum(length(b) + length(f)) OVER (PARTITION BY doc_id, nr ORDER BY i) AS stop FROM single),
    spans AS (
        SELECT doc_id, owner, repo, kind, nr, v, stop - length(f) AS start, stop, {_RANDOM} AS random
        FROM placed WHERE length(v) >= least),
    candidates AS (
        SELECT * FROM spans s WHERE nr < 3 OR (random AND NOT EXISTS (
            SELECT 1 FROM spans o WHERE o.doc_id = s.doc_id AND o.nr < 3 AND o.start < s.stop AND s.start < o.stop))),
    spread AS (SELECT v, count(DISTINCT owner) AS owners FROM candidates GROUP BY v),
    judged AS (
        SELECT c.*, CASE WHEN owners > 1 THEN 'example' WHEN random OR kind IN ('access', 'hex') THEN 'live' ELSE 'plain' END AS verdict,
               kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span
        FROM candidates c JOIN spread USING (v)),
    result AS (SELECT * FROM judged WHERE nr < 3 OR verdict = 'live')
    SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
           count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE kind = 'owned') AS n_owned,
           sha256(coalesce(string_agg(span, ',' ORDER BY start, nr) FILTER (WHERE nr < 3), '')) AS base_sha256,
           coalesce(string_agg(span, ',' ORDER BY start, nr), '') AS spans,
           count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example
    FROM documents LEFT JOIN result USING (doc_id) GROUP BY doc_id""")
def op8_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, repository=F.concat_ws("/", "source", "lang"), owner=c("source"))

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(field, value):
        return F.size(F.filter("spans", lambda x: x[field] == value)).cast("long").alias(f"n_{value}")

    base = F.filter("spans", lambda x: x["kind"] != "owned")
    return found.select(
        "doc_id", *(count("kind", kind) for kind in KINDS), F.sha2(text(base), 256).alias("base_sha256"),
        text(c("spans")).alias("spans"), *(count("verdict", verdict) for verdict in ("live", "example")))


@query("op5_vector_search", """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score
               FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20""")
def op5_vector_search(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def dated_entries(pages):
    """A dated block list that follows from the pages: the digits of each domain's MD5 tell
    whether, where and when the domain is listed, removed and listed again."""
    domains = pages.select(F.explode(domains_of(host_of(c("url")), least=2)).alias("domain")).distinct()
    digits = F.md5(c("domain"))

    def number(start, length):
        return F.conv(F.substring(digits, start, length), 16, 10).cast("int")

    first = F.date_add(F.lit("2024-01-01").cast("date"), number(3, 2))
    gone = F.date_add(first, number(5, 2) + 1)
    steps = F.array(
        F.struct(F.lit("add").alias("action"), first.alias("day")),
        F.when(number(7, 1) >= 4, F.struct(F.lit("remove").alias("action"), gone.alias("day"))),
        F.when((number(7, 1) >= 4) & (number(8, 1) >= 8), F.struct(F.lit("add").alias("action"), F.date_add(gone, 30).alias("day"))))
    return domains.filter(number(1, 1) < 6).select(
        F.when(number(2, 1) < 8, "ads").otherwise("malware").alias("list"), "domain",
        F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("step")).select("list", "domain", "step.day", "step.action")


@query("op7_url_filter", r"""
    WITH captures AS (
        SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
               trim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS host
        FROM pages),
    parts AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM captures WHERE host <> ''),
    suffixes AS (SELECT host, len(l) - i + 1 AS n, array_to_string(l[i:], '.') AS domain
                 FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM parts)),
    digits AS (SELECT domain, md5(domain) AS m FROM (SELECT DISTINCT domain FROM suffixes WHERE n >= 2)),
    numbers AS (
        SELECT domain, CAST('0x' || m[1:1] AS INTEGER) AS a, CAST('0x' || m[2:2] AS INTEGER) AS b,
               CAST('0x' || m[3:4] AS INTEGER) AS c, CAST('0x' || m[5:6] AS INTEGER) AS d,
               CAST('0x' || m[7:7] AS INTEGER) AS e, CAST('0x' || m[8:8] AS INTEGER) AS f FROM digits),
    listed AS (
        SELECT domain, CASE WHEN b < 8 THEN 'ads' ELSE 'malware' END AS list, DATE '2024-01-01' + c AS since,
               CASE WHEN e >= 4 THEN DATE '2024-01-01' + c + d + 1 END AS until FROM numbers WHERE a < 6
        UNION ALL
        SELECT domain, CASE WHEN b < 8 THEN 'ads' ELSE 'malware' END, DATE '2024-01-01' + c + d + 31, NULL
        FROM numbers WHERE a < 6 AND e >= 4 AND f >= 8),
    hits AS (
        SELECT c.host, c.fetched, l.list, l.domain, l.since,
               row_number() OVER (PARTITION BY c.host, c.fetched ORDER BY length(l.domain) DESC, l.list) AS nr
        FROM (SELECT DISTINCT host, fetched FROM captures) c JOIN suffixes s ON s.host = c.host
        JOIN listed l ON l.domain = s.domain AND l.since <= c.fetched AND (l.until IS NULL OR c.fetched < l.until))
    SELECT page_id, url, c.host, c.fetched, h.host IS NOT NULL AS blocked, list, "domain", CAST(since AS DATE) AS since
    FROM captures c LEFT JOIN hits h ON h.host = c.host AND h.fetched = c.fetched AND h.nr = 1""")
def op7_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (c("page_id") % 366).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched"))
    return filter_urls(captures, dated_entries(pages))


@query("op3_suffix_dedup", """
    WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
    windows AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS s
                FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
    repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
    short AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS s
              FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
    told AS (SELECT doc_id, CAST(sum(least(200, coalesce(next - i, 200))) AS BIGINT) AS n_repeated
             FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM short
                   JOIN (SELECT s FROM short GROUP BY s HAVING count(*) > 1) USING (s)) GROUP BY doc_id),
    hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows JOIN repeated USING (s)),
    runs AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY doc_id, run),
    pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM spans),
    kept AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, max(b) AS stop,
                    string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS t FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
           sha256(unhex(coalesce(t, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256,
           coalesce(n_repeated, 0) AS n_repeated
    FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN told USING (doc_id)""")
def op3_suffix_dedup(spark, sf_dir):
    found = suffix_dedup(table(spark, sf_dir, "documents"), length=400, report=200)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def _lloyd_sql(parts: int = 4, size: int = 256, rounds: int = 4) -> str:
    """Codebooks b0, b1, ...; assignments a0, a1, ..., each as a table."""
    steps = [f"""
    WITH v AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1024) AS DOUBLE)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (
        SELECT vec_id, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS x
        FROM (SELECT *, unnest(range({parts})) AS part FROM v)),
    b0 AS MATERIALIZED (
        SELECT part, j, x FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS j, x FROM p) WHERE j < {size})"""]
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} AS MATERIALIZED (
        SELECT vec_id, part, any_value(x) AS x, min(CAST(nx - 2 * list_dot_product(x, y) + ny AS BIGINT) * {size} + j) AS m
        FROM (SELECT *, list_dot_product(x, x) AS nx FROM p)
        JOIN (SELECT part, j, x AS y, list_dot_product(x, x) AS ny FROM b{i}) USING (part) GROUP BY vec_id, part)""")
        if i < rounds:
            steps.append(f"""
    b{i + 1} AS MATERIALIZED (
        SELECT part, j, coalesce(list(floor(total / n) ORDER BY pos) FILTER (WHERE n IS NOT NULL), any_value(x)) AS x
        FROM b{i} LEFT JOIN (
            SELECT part, m % {size} AS j, pos, sum(x[pos]) AS total, count(*) AS n
            FROM (SELECT *, unnest(range(1, len(x) + 1)) AS pos FROM a{i}) GROUP BY part, m % {size}, pos) USING (part, j)
        GROUP BY part, j)""")
    return ",".join(steps) + f""",
    books AS (
        SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, j, pos)) AS codebooks_sha256
        FROM (SELECT part, j, unnest(x) AS c, unnest(range(len(x))) AS pos FROM b{rounds})),
    coded AS (
        SELECT vec_id, label, string_agg(lower(printf('%02x', m % {size})), '' ORDER BY part) AS code,
               CAST(sum(m // {size}) AS BIGINT) AS error
        FROM a{rounds} JOIN v USING (vec_id) GROUP BY vec_id, label)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded, books"""


@query("op11_vector_codes", _lloyd_sql())
def op11_vector_codes(spark, sf_dir):
    coded, books = compress(table(spark, sf_dir, "embeddings"), keep=("label",), parts=4, size=256, rounds=4, scale=1024)
    found = with_label_error(checkpointed(coded), "label")
    code = F.concat_ws("", F.transform("codes", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))))
    return found.select("vec_id", code.alias("code"), "error", "label_error",
                        F.sha2(F.lit(codebook_text(books)), 256).alias("codebooks_sha256"))


@query("op12_spelling_variants", r"""
    WITH RECURSIVE crc_table AS (
        SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT] || list_transform(range(8), lambda z: 0::UBIGINT),
            lambda c, y: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS t),
    runs AS (
        SELECT doc_id, run, count(*) AS n, encode(CAST(doc_id AS VARCHAR) || ':' || run) AS bytes
        FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                       'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
        GROUP BY doc_id, run),
    hashed AS (
        SELECT run, n, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(octet_length(bytes)),
                   lambda i: ('0x' || substr(hex(bytes), 2 * i + 1, 2))::UBIGINT),
                   lambda a, b: xor(t[1 + CAST(xor(a, b) & 255 AS INTEGER)], a >> 8)), 4294967295::UBIGINT) AS h FROM runs, crc_table),
    spelled AS (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
               ELSE run END AS word, n FROM hashed),
    words AS MATERIALIZED (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    cut AS MATERIALIZED (
        SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
    near AS (
        SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
        UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)),
    best AS (
        SELECT near.word, count(*) AS n_near, max(o.n) AS form_n, arg_min(o.word, (-o.n, o.word)) AS form
        FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
    formed AS MATERIALIZED (
        SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * words.n THEN form END AS form,
               CASE WHEN form_n >= 2 * words.n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
    follow AS (
        SELECT word, word AS root, 0 AS depth FROM formed
        UNION ALL SELECT follow.word, formed.form, depth + 1 FROM follow JOIN formed ON formed.word = follow.root
        WHERE formed.form IS NOT NULL),
    roots AS (SELECT word, arg_max(root, depth) AS root FROM follow GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)""")
def op12_spelling_variants(spark, sf_dir):
    words = corpus_words(table(spark, sf_dir, "documents"), least_chars=5, least_count=3, misspell_one_in=97)
    return spelling_variants(words, factor=2)


@query("op13_quality")
def op13_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    machine = quality.train(docs, table(spark, sf_dir, "labels"), teach=~quality.held_out("doc_id"))
    rows = docs.select(F.struct("doc_id", quality.held_out("doc_id").alias("held_out")).alias("row"), "text", "n_chars")
    return quality.score(rows, machine, "row").select(
        "row.*", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
