"""Outputs: JSON, CSV, SARIF, baseline, ledger files.  Written by tasks, in parts."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scoring import band, report_level
from .operators.findings import display_order, fingerprint, keep_first
from .operators.ledger import apply_results
from .operators.view import numbered
from .schemas import LEDGER
from .tables import Table, is_table

c = F.col
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
TOOL = "tracewright"


def public_columns(df: DataFrame) -> DataFrame:
    """Without helper columns (``emit_ord`` and names starting with ``_``)."""
    return df.select(*[name for name in df.columns if name != "emit_ord" and not name.startswith("_")])


def write_json(findings: DataFrame, path: str, by_repo: bool = False) -> None:
    """One JSON object per finding and line; ``by_repo`` makes a folder per repository."""
    writer = public_columns(findings).write.mode("overwrite")
    (writer.partitionBy("repo") if by_repo else writer).json(path)


def csv_rows(findings: DataFrame) -> DataFrame:
    """The seven columns of the list export."""
    return findings.select(
        "rule_id", band("severity.score", zero_is_low=True).alias("severity"), c("severity.score").alias("score"),
        "file", "line", "function", "status")


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", True).csv(path)


def _sarif_rules(findings: DataFrame) -> DataFrame:
    first = keep_first(
        findings.select("rule_id", "evidence", "severity", F.struct(*display_order()).alias("_o")), ["rule_id"], "_o")
    return first.select(F.struct(
        c("rule_id").alias("id"), F.struct(F.concat(F.lit("Rule "), c("rule_id")).alias("text")).alias("shortDescription"),
        F.struct(c("evidence").alias("text")).alias("fullDescription"),
        F.struct(report_level("severity.score").alias("level")).alias("defaultConfiguration")).alias("rule"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(rule_id, file, line, function, result): each finding as a SARIF result object."""
    result = F.struct(
        c("rule_id").alias("ruleId"), report_level("severity.score").alias("level"), F.struct(c("evidence").alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(c("file").alias("uri")).alias("artifactLocation"),
            F.struct(F.greatest(c("line"), F.lit(1)).alias("startLine")).alias("region"),
        ).alias("physicalLocation"))).alias("locations"))
    return findings.select(*display_order(), "id", F.to_json(result).alias("result"))


def sarif_lines(findings: DataFrame, version: str = "0.1.0") -> DataFrame:
    """(number, line): a SARIF 2.1.0 document, one line per result.

    The document is a sorted table; read in order its lines are one JSON document, so
    it never has to be in one place to be built.
    """
    order = [*display_order(), c("id")]
    body = numbered(sarif_results(findings), order).select(
        "number", F.concat(F.when(c("number") > 1, ",").otherwise(""), c("result")).alias("line"))
    rules = _sarif_rules(findings).agg(F.array_sort(F.collect_list("rule")).alias("rules"))  # one entry per rule
    driver = F.to_json(F.struct(F.lit(TOOL).alias("name"), F.lit(version).alias("version"), c("rules")))
    head = rules.select(F.lit(0).cast("long").alias("number"), F.concat(
        F.lit('{"$schema":"' + SARIF_SCHEMA + '","version":"2.1.0","runs":[{"tool":{"driver":'), driver, F.lit('},"results":[')).alias("line"))
    foot = findings.sparkSession.range(1).select(F.lit((1 << 63) - 1).alias("number"), F.lit("]}]}").alias("line"))
    return head.unionByName(body).unionByName(foot)


def write_sarif(findings: DataFrame, path: str) -> None:
    """Part files that, concatenated in name order, are one SARIF document."""
    sarif_lines(findings).orderBy("number").select("line").write.mode("overwrite").text(path)


def payload_lines(groups: dict[str, DataFrame]) -> DataFrame:
    """(number, line): one document ``{"<name>": [...], ...}``, a line per finding in
    display order; as JSON it is YAML too.  Built like a SARIF document."""
    parts = []
    for position, (name, findings) in enumerate(groups.items()):
        rows = numbered(public_columns(findings), [*display_order(), c("id")])
        fields = [f for f in rows.columns if f != "number"]
        parts.append(rows.select(
            F.lit(2 * position + 1).alias("section"), "number",
            F.concat(F.when(c("number") > 1, ",").otherwise(""), F.to_json(F.struct(*fields))).alias("line")))
        opening = ("{" if position == 0 else "],") + json.dumps(name) + ":["
        parts.append(rows.sparkSession.range(1).select(
            F.lit(2 * position).alias("section"), F.lit(0).cast("long").alias("number"), F.lit(opening).alias("line")))
    last = parts[0].sparkSession.range(1).select(
        F.lit(2 * len(groups)).alias("section"), F.lit(0).cast("long").alias("number"), F.lit("]}").alias("line"))
    return reduce(DataFrame.unionByName, [*parts, last])


def payload_by_repo(findings: DataFrame, repos: list[str]) -> DataFrame:
    """(section, number, line): one document ``{"results": {"<repo>": [...], ...}}`` with a list for each
    repository, also for one without findings.

    A line that is not a repository's first one begins with a comma, so rows are numbered within their repository: a
    running number less the number of rows in the repositories before (as many counts as repositories).
    """
    names = sorted(repos)
    order = [c("repo"), *display_order(), c("id")]
    rows = numbered(public_columns(findings), [*order], "_row")
    before, starts = 0, []
    counts = {r.repo: r["count"] for r in findings.groupBy("repo").count().collect()}
    for name in names:
        starts.append((name, names.index(name), before))
        before += counts.get(name, 0)
    place = findings.sparkSession.createDataFrame(starts, "repo string, section int, before long")
    fields = [f for f in rows.columns if f != "_row"]
    number = c("_row") - c("before")
    body = rows.join(F.broadcast(place), ["repo"]).select(
        (2 * c("section") + 1).alias("section"), number.alias("number"),
        F.concat(F.when(number > 1, ",").otherwise(""), F.to_json(F.struct(*fields))).alias("line"))
    heads = [(2 * i, 0, ('{"results":{' if i == 0 else "],") + json.dumps(name) + ":[") for i, name in enumerate(names)]
    heads.append((2 * len(names), 0, "]}}" if names else '{"results":{}}'))
    return body.unionByName(findings.sparkSession.createDataFrame(heads, "section int, number long, line string"))


def write_payload(groups: dict[str, DataFrame], path: str) -> None:
    """Part files that, concatenated in name order, are one document."""
    _write_lines(payload_lines(groups), path)


def write_payload_by_repo(findings: DataFrame, repos: list[str], path: str) -> None:
    _write_lines(payload_by_repo(findings, repos), path)


def _write_lines(lines: DataFrame, path: str) -> None:
    lines.orderBy("section", "number").select("line").write.mode("overwrite").text(path)


def baseline(findings: DataFrame) -> DataFrame:
    return findings.select(fingerprint().alias("fingerprint")).distinct()


def write_baseline(findings: DataFrame, path: str) -> None:
    """Known fingerprints, sorted, one JSON object per line."""
    baseline(findings).orderBy("fingerprint").withColumn("version", F.lit(1)).write.mode("overwrite").json(path)


def read_baseline(spark, path: str) -> DataFrame:
    """A baseline of either form: lines, or one document with a ``fingerprints`` list.

    Lines are read as such, however large the files are; only a baseline without any is
    read as documents.  A missing path or malformed text knows nothing; any other failure
    (rights, network) is raised, as it would bring every known finding back.
    """
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.text(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "fingerprint string")
    lines = raw.select(F.get_json_object("value", "$.fingerprint").alias("fingerprint")).where("fingerprint IS NOT NULL")
    if not lines.isEmpty():
        return lines.distinct()
    document = F.get_json_object("value", "$.fingerprints")
    return spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json(document, "array<string>")).alias("fingerprint")).distinct()


# ---- ledger ----------------------------------------------------------------------------
def ledger_table(spark, path: str, parts: int = 64) -> Table:
    """The ledger as a table in versions (see ``tables``)."""
    return Table(spark, path, LEDGER, ["id"], parts)


def write_ledger(ledger: DataFrame, path: str, base: int | None = None) -> int:
    """Add the rows whose id the ledger does not have, as a new version; its number.

    ``base``: the version that the rows were derived from; if another writer has committed since,
    nothing is written and ``StaleVersion`` raised."""
    return ledger_table(ledger.sparkSession, path).insert_absent(ledger, base=base)


def write_results(spark, path: str, results: DataFrame, today: str, base: int | None = None) -> int:
    """Record proof results in the ledger, as a new version; only the parts that hold their findings
    are written."""
    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        return apply_results(old, new.withColumnRenamed("id", "finding_id"), today)

    return ledger_table(spark, path).merge(results.withColumnRenamed("finding_id", "id"), change, base)


def read_ledger(spark, path: str) -> DataFrame:
    """The newest version of a ledger table, or the entries of a folder of YAML files."""
    if is_table(spark, path):
        return ledger_table(spark, path).read()
    return read_ledger_folder(spark, path)


_ENTRY = f"{LEDGER}, source string, problem string"


def ledger_entries(spark, folder: str) -> DataFrame:
    """Ledger kept as one YAML file per finding (also in sibling ``findings_latest_*`` folders), read
    inside tasks: the entry's columns, the file's path, and what is wrong with the file, if
    it could not be read as an entry."""
    import pyarrow as pa

    from .schemas import arrow_schema
    from .sources.files import list_files, read_contents

    parent = os.path.dirname(os.path.abspath(folder))
    siblings = sorted(n for n in os.listdir(parent) if n.startswith("findings_latest_")) if os.path.isdir(parent) else []
    folders = {"ledger": folder, **{n: os.path.join(parent, n) for n in siblings if os.path.join(parent, n) != os.path.abspath(folder)}}
    schema = arrow_schema(_ENTRY)
    types = {f.name: f.type for f in schema if f.name not in ("source", "problem")}

    def history(value):
        if not isinstance(value, list):
            return []
        return [{k: None if v is None else (v if isinstance(v, int) else None) if k == "proof_tier" else str(v) for k, v in entry.items()
                 if k in ("date", "status", "proof_tier", "reproducer_hash")} for entry in value if isinstance(entry, dict)]

    def fit(name, value):
        kind = types[name]
        if name == "status_history":
            return history(value)
        if value is None:
            return None
        if kind == pa.int32():
            return value if isinstance(value, int) and abs(value) < 1 << 31 else None
        return bool(value) if kind == pa.bool_() else str(value)

    def entry_of(content):
        """(columns, problem)"""
        import yaml

        if content is None:
            return {}, "file cannot be read"
        try:
            entry = yaml.safe_load(content)
        except (yaml.YAMLError, UnicodeDecodeError, ValueError, RecursionError) as problem:
            return {}, f"no YAML: {str(problem).splitlines()[0][:200] if str(problem) else type(problem).__name__}"
        if not isinstance(entry, dict):
            return {}, "no mapping"
        return {name: fit(name, entry.get(name)) for name in types}, None

    def parse(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("abs_path").to_pylist(), batch.column("content").to_pylist()):
                entry, problem = entry_of(content)
                rows.append({**entry, "source": path, "problem": problem})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = read_contents(list_files(spark, folders, "*.yaml"))
    return files.mapInArrow(parse, _ENTRY)


def read_ledger_folder(spark, folder: str) -> DataFrame:
    """The entries of a folder of YAML files; ``ledger_problems`` has the files that are none."""
    return ledger_entries(spark, folder).where("problem IS NULL").drop("source", "problem")


def ledger_problems(spark, folder: str) -> DataFrame:
    """(source, problem): files of a ledger folder that cannot be read or are no entry."""
    return ledger_entries(spark, folder).where("problem IS NOT NULL").select("source", "problem")


def write_ledger_folder(ledger: DataFrame, folder: str) -> None:
    """One YAML file per finding, only where none exists; each file appears whole."""
    def write(rows):
        import yaml

        os.makedirs(folder, exist_ok=True)
        for row in rows:
            target = os.path.join(folder, f"{row['id']}.yaml")
            if not os.path.exists(target):
                part = f"{target}.{os.getpid()}.tmp"
                with open(part, "w", encoding="utf-8") as handle:
                    yaml.safe_dump({k: v for k, v in row.asDict(recursive=True).items() if k != "status_history" or v}, handle, sort_keys=False)
                os.replace(part, target)

    ledger.foreachPartition(write)
