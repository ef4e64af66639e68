"""Canonical schemas (DDL) shared by sources, operators and sinks."""

from __future__ import annotations

SOURCE_FILES = "repo string, path string, abs_path string, content binary"

SYNTAX_ROWS = """
    repo string, path string, ord int, kind string,
    symbol_id string, func string, fn int, cls int,
    name string, raw string, attr string, shape string, receiver string,
    owner string, owner_text string, flag boolean, n_args int,
    arg_names array<string>, arg_texts array<string>, keywords array<string>,
    keyword_values array<struct<key:string,name:string,text:string>>,
    arg0 struct<node:string,text:string,origins:array<string>,callee:string,method:string,template:string>,
    value0 struct<node:string,text:string,origins:array<string>,callee:string,inner_node:string,inner_origins:array<string>>,
    receiver_origins array<string>,
    names array<string>, calls array<string>, methods array<string>, body_calls array<string>,
    decorators array<struct<name:string,flags:map<string,boolean>>>,
    defaults array<struct<arg:string,kind:string>>,
    bases array<struct<name:string,qualified:boolean>>,
    line_start int, line_end int, hash string
"""

DOCTYPES = """
    repo string, name string, module string, path string, table_name string,
    is_submittable boolean, istable boolean, is_amendable boolean, owner_scoped boolean,
    autoname string,
    fields array<struct<fieldname:string,fieldtype:string,options:string>>,
    permissions array<struct<role:string,permlevel:int,read:boolean,write:boolean,
        create:boolean,submit:boolean,cancel:boolean,if_owner:boolean>>
"""

HOOK_LEAVES = """
    repo string, path string, abs_path string, app string, pos int,
    section string, keys array<string>, value string, item int, problem string
"""

CANDIDATE_COLUMNS = (
    "repo", "rule_id", "rule_version", "taxonomy_id", "file", "line", "function",
    "code_location_hash", "evidence", "proof_recipe", "proof_tier", "status",
    "fix_confidence", "target_arg", "emit_ord",
)

LEDGER = """
    id string, taxonomy_id string, rule_id string, rule_version string, repo string,
    file string, function string, status string, proof_tier int,
    privilege_required string, allow_guest boolean, impact_class string,
    blast_radius string, code_location_hash string, discovered string, proven string,
    notes string, reproducer_hash string, upstream_pr string,
    status_history array<struct<date:string,status:string,proof_tier:int,reproducer_hash:string>>
"""

FALSE_POSITIVES = """
    finding_id string, rule_id string, rule_version string, repo string,
    file string, function string, code_location_hash string, reason string
"""

PROOF_RESULTS = """
    finding_id string, status string, proof_tier int, exit_code int, stdout string,
    stderr string, duration_seconds double, reproducer_path string,
    error_message string, reproducer_hash string
"""

SCAN_RECORDS = "scan_id string, repo_path string, started_at double, finished_at double, status string"

FINDING_RECORDS = """
    finding_id string, scan_id string, rule_id string, rule_version string, taxonomy_id string,
    file string, line int, function string, code_location_hash string, evidence string,
    description string, remediation string, proof_recipe string, proof_tier int, status string,
    proof_status string, fix_confidence string, target_arg string, severity_score double,
    severity_json string, created_at double
"""

PROOF_RECORDS = """
    finding_id string, exit_code int, stdout string, stderr string, reproducer_path string,
    reproducer_source string, error_message string, duration_seconds double,
    proof_status string, proof_tier int, proved_at double
"""

FIX_PATCHES = """
    finding_id string, rule_id string, file string, line int, start_line int, end_line int,
    modified_source string, diff string, description string, is_valid boolean
"""


def arrow_schema(ddl: str):
    """Arrow schema of a DDL string (for functions that build record batches)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
