"""Check SQL: the same results computed by another engine from the same tables.

Written from the semantics, not from the Spark plans. Corpora come from the shared text in
``workload.corpora``.
"""

from auditlake import config
from auditlake.functions.labels import CVSS_BASE, DETECTOR_CONFIDENCE, EXPLOIT_HIGH, EXPLOIT_MEDIUM
from auditlake.rules import config_rules as cr
from auditlake.rules import templates as tp
from auditlake.rules import weaknesses as wk
from auditlake.rules.vuln_db import VULNERABILITIES
from workload.corpora import CORPORA, ctes

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ql(texts) -> str:
    return "(" + ", ".join(q(t) for t in texts) + ")"


def body(text: str) -> str:
    """A literal that may hold line breaks."""
    return "concat(" + ", chr(10), ".join(q(part) for part in text.split("\n")) + ", '')"


def values(name: str, columns: str, rows) -> str:
    rendered = ", ".join("(" + ", ".join(r) + ")" for r in rows)
    return f"{name}({columns}) as (values {rendered})"


# --- Paths ----------------------------------------------------------------------------------

NAME = "lower(string_split(path, '/')[-1])"
EXT = "lower(regexp_extract(string_split(path, '/')[-1], '(?s)^.+(\\.[^.]+)$', 1))"
KEPT = f"not list_has_any(string_split(path, '/')[:-2], [{', '.join(q(d) for d in config.IGNORED_DIRS)}])"
SOURCE = f"{EXT} in {ql(config.SUPPORTED_EXTENSIONS)}"
SMALL = "size <= 10485760"
KIND = f"""case when {NAME} = 'dockerfile' or {EXT} = '.dockerfile' then 'dockerfile'
 when {NAME} in ('docker-compose.yml', 'docker-compose.yaml') then 'compose'
 when {EXT} = '.tf' then 'terraform'
 when {NAME} = '.gitlab-ci.yml' then 'gitlab'
 when {NAME} = 'jenkinsfile' or {EXT} = '.jenkinsfile' then 'jenkins'
 when {EXT} in ('.yml', '.yaml') and contains(path, '.github/workflows') then 'github-actions'
 when {EXT} in ('.yml', '.yaml') and contains(lower(content), 'apiversion:') and contains(lower(content), 'kind:') then 'kubernetes'
 when {EXT} in ('.yml', '.yaml') and contains(lower(content), 'awstemplateformatversion') then 'cloudformation' end"""

MIXED = ctes("mixed_files")
ORACLES["prune_ignored_dirs"] = f"{MIXED} select repo, path, size from mixed_files where {KEPT}"
ORACLES["select_by_extension"] = f"{MIXED} select repo, path from mixed_files where {SOURCE}"
ORACLES["size_limit"] = f"{MIXED} select repo, path, size from mixed_files where {SMALL}"
ORACLES["select_scan_sets"] = f"""{MIXED} select repo, path,
 {KEPT} and {SOURCE} and {SMALL} as for_review,
 {KEPT} and ({SOURCE} or {NAME} = '.env' or {EXT} = '.env') and {SMALL} as for_secrets,
 {KEPT} and {NAME} in {ql(config.MANIFEST_NAMES)} as for_dependencies,
 ({KEPT} or contains(path, '.github/workflows')) and ({NAME} in ('dockerfile', 'jenkinsfile')
   or {EXT} in ('.dockerfile', '.jenkinsfile', '.tf', '.yml', '.yaml')) as for_config,
 {EXT} in {ql(config.EXPOSURE_EXTENSIONS)} or {NAME} = 'dockerfile' as for_exposure,
 {EXT} in {ql(config.REACHABILITY_EXTENSIONS)} as for_reachability
from mixed_files"""
ORACLES["stage_filter"] = f"""{MIXED} select repo, path from mixed_files where {KEPT} and {SMALL}
 and ({EXT} in {ql(config.SUPPORTED_EXTENSIONS + config.STAGED_EXTENSIONS)} or {NAME} in {ql(config.STAGED_NAMES)})"""
ORACLES["decode_lossy"] = "select page_id, md5(concat(html, 'A')) as text_md5 from pages"
LINES = """select repo, file, i as line_no, parts[i] as text from (
  select repo, path as file, string_split(content, chr(10)) as parts, case when content = '' or content like concat('%', chr(10))
    then len(string_split(content, chr(10))) - 1 else len(string_split(content, chr(10))) end as n from {files}) f,
 lateral (select unnest(range(1, n + 1)) as i)"""
ORACLES["explode_lines"] = f"{ctes('code_files')} {LINES.format(files='code_files')}"
ORACLES["classify_config"] = f"{MIXED} select repo, path, {KIND} as kind from mixed_files"
ORACLES["review_candidates"] = f"""{MIXED} select repo, path, rank from (
 select repo, path, row_number() over (partition by repo order by path) as rank from mixed_files where {KEPT} and {SOURCE} and {SMALL})
 where rank <= 5"""
ORACLES["scan_warnings"] = f"""{MIXED} select repo, path,
 concat('Skipped ', string_split(path, '/')[-1], ' (exceeds size limit of 10MB)') as warning
 from mixed_files where {KEPT} and {SOURCE} and not {SMALL}"""
ORACLES["scan_stats"] = f"""{ctes('mixed_files', 'bandit_reports', 'tool_status')},
 per_repo as (select repo, count(*) filter (where {KEPT} and {SOURCE} and {SMALL}) as scanned_files,
   count(*) filter (where {KEPT} and {SOURCE} and not {SMALL}) as skipped_files from mixed_files group by repo),
 b as (select replace(repo, 'repo', 'src') as repo, count(*) as n from bandit_reports group by 1),
 c as (select distinct replace(repo, 'repo', 'src') as repo from tool_status where tool = 'codeql' and status = 'database-created')
select p.repo, scanned_files, skipped_files, coalesce(b.n, 0) as bandit, cast(case when c.repo is null then 0 else 1 end as bigint) as codeql
from per_repo p left join b on b.repo = p.repo left join c on c.repo = p.repo"""
ORACLES["display_path"] = f"{ctes('findings')} select ord, concat(repo, '/', file) as file from findings"

# --- Policies -------------------------------------------------------------------------------

RESOLVED = """ranked as (select *, row_number() over (partition by repo order by
   case file_name when '.security.yaml' then 1 when 'security.yaml' then 2 when '.security.yml' then 3 else 4 end) as place
  from policy_files where parsed),
 resolved as (select r.repo, p.repo is not null as own, coalesce(p.fail_on, 'critical,high') as fail_on,
   coalesce(p.high, 0) as high_limit, p.medium as medium_limit, p.low as low_limit,
   coalesce(p.secrets, true) as scan_secrets, coalesce(p.sast, true) as scan_sast, coalesce(p.timeout, 600) as timeout
  from policy_repos r left join ranked p on p.repo = r.repo and p.place = 1)"""
POLICY = f"{ctes('policy_files', 'policy_repos')}, {RESOLVED}"
LIMIT_TEXT = """concat('critical=0,high=', high_limit, case when medium_limit is null then '' else concat(',medium=', medium_limit) end,
 case when low_limit is null then '' else concat(',low=', low_limit) end)"""
ORACLES["policy_merge"] = f"""{POLICY} select repo, fail_on, {LIMIT_TEXT} as thresholds, scan_sast, scan_secrets,
 true as scan_dependencies, true as scan_iac, true as scan_ai_review, false as network, cast(timeout as bigint) as timeout,
 '4GB' as memory, cast(2 as bigint) as cpu from resolved"""
ORACLES["policy_join"] = f"""{ctes('policy_files', 'policy_repos', 'findings')}, {RESOLVED}
select f.repo, coalesce(fail_on, 'critical,high') as fail_on, case when r.repo is null then 'critical=0,high=0' else {LIMIT_TEXT} end as thresholds
from (select distinct repo from findings) f left join resolved r on r.repo = f.repo"""
ORACLES["scanner_plan"] = f"""{POLICY},
 runs(profile, scanner, switch) as (values ('comprehensive', 'bandit', 'sast'), ('comprehensive', 'codeql', 'sast'), ('comprehensive', 'ai', 'ai'),
  ('local_only', 'bandit', 'sast'), ('local_only', 'codeql', 'sast'),
  ('comprehensive', 'secrets', 'secrets'), ('comprehensive', 'sca', 'on'), ('comprehensive', 'iac', 'on'),
  ('local_only', 'secrets', 'secrets'), ('local_only', 'sca', 'on'), ('local_only', 'iac', 'on'),
  ('ast_only', 'secrets', 'secrets'), ('ast_only', 'sca', 'on'), ('ast_only', 'iac', 'on'))
select repo, profile, scanner from resolved, runs
where case switch when 'sast' then scan_sast when 'secrets' then scan_secrets else true end"""

# --- Reports --------------------------------------------------------------------------------

ORACLES["ingest_bandit"] = f"""{ctes('bandit_reports')},
 r as (select repo, unnest(from_json(json_extract(regexp_extract(report, '(?s)\\{{.*\\}}', 0), '$.results'), '["JSON"]')) as x from bandit_reports)
select repo, json_extract_string(x, '$.filename') as file, cast(json_extract_string(x, '$.line_number') as bigint) as line,
 coalesce(json_extract_string(x, '$.test_id'), 'bandit') as rule,
 case when coalesce(json_extract_string(x, '$.issue_cwe.id'), '0') = '0' then 'CWE-77' else concat('CWE-', json_extract_string(x, '$.issue_cwe.id')) end as cwe,
 lower(coalesce(json_extract_string(x, '$.issue_severity'), 'medium')) as severity,
 coalesce(json_extract_string(x, '$.issue_text'), 'Bandit detected issue') as description from r"""
ORACLES["map_bandit_cwe"] = """select event_id, case event_id % 5 when 0 then concat('CWE-', event_id % 90)
 when 1 then case when event_id % 90 = 0 then 'CWE-77' else concat('CWE-', event_id % 90) end else 'CWE-77' end as cwe from events"""
ORACLES["ingest_codeql_marker"] = f"""{ctes('tool_status')} select distinct repo, 'codeql-integrated' as rule, 'CWE-79' as cwe,
 'medium' as severity, 'CodeQL semantic vulnerability check complete' as description, cast(null as bigint) as line
 from tool_status where tool = 'codeql' and status = 'database-created'"""


def mask(value: str, provider: str) -> str:
    def keep(prefix: str) -> str:
        return f"concat('{prefix}', repeat('*', length({value}) - {len(prefix)}))"

    return f"""case when length({value}) <= 8 then '********'
 when {provider} = 'github' and starts_with({value}, 'ghp_') then {keep('ghp_')}
 when {provider} = 'openai' and starts_with({value}, 'sk-proj-') then {keep('sk-proj-')}
 when {provider} = 'openai' and starts_with({value}, 'sk-') then {keep('sk-')}
 when {provider} = 'anthropic' and starts_with({value}, 'sk-ant-sid01-') then {keep('sk-ant-sid01-')}
 else concat(left({value}, 4), repeat('*', length({value}) - 8), right({value}, 4)) end"""


ORACLES["ingest_gitleaks"] = f"""{ctes('gitleaks_reports')},
 r as (select repo, unnest(from_json(report, '["JSON"]')) as x from gitleaks_reports),
 s as (select repo, json_extract_string(x, '$.File') as file, coalesce(cast(json_extract_string(x, '$.StartLine') as bigint), 1) as line,
  json_extract_string(x, '$.RuleID') as given, json_extract_string(x, '$.Secret') as value, json_extract_string(x, '$.Description') as about from r),
 t as (select *, string_split(lower(coalesce(given, 'generic')), '-')[1] as provider from s)
select repo, file, line, coalesce(given, 'gitleaks-secret') as rule, provider, {mask('value', 'provider')} as secret,
 concat('Exposed secret detected: ', coalesce(about, 'Hardcoded credential')) as description, 'SECRET' as type from t"""
OSV_BASE = f"""{ctes('osv_reports')},
 r as (select repo, unnest(from_json(json_extract(report, '$.results'), '["JSON"]')) as x from osv_reports),
 p as (select repo, json_extract_string(x, '$.source.path') as file, unnest(from_json(json_extract(x, '$.packages'), '["JSON"]')) as y from r),
 n as (select repo, file, coalesce(json_extract_string(y, '$.package.name'), '') as package,
  coalesce(json_extract_string(y, '$.package.version'), '') as installed, y from p)"""
ORACLES["ingest_osv"] = f"""{OSV_BASE},
 v as (select repo, file, package, installed, unnest(from_json(json_extract(y, '$.vulnerabilities'), '["JSON"]')) as z from n),
 w as (select *, json_extract_string(z, '$.summary') as summary, json_extract_string(z, '$.details') as details,
  list_filter(coalesce(from_json(json_extract(z, '$.aliases'), '["VARCHAR"]'), []), lambda a: starts_with(a, 'CVE-'))[1] as alias from v)
select repo, file, concat('sca-', package) as rule, package, installed,
 coalesce(alias, json_extract_string(z, '$.id'), 'GHSA-unknown') as cve,
 case when contains(lower(coalesce(summary, '')), 'critical') or contains(lower(coalesce(details, '')), 'critical') then 'critical' else 'high' end as severity,
 concat('Vulnerable dependency ', package, ' (', installed, ') detected via OSV: ', coalesce(summary, 'Vulnerable package version.')) as description from w"""
ORACLES["ingest_osv_deps"] = f"""{OSV_BASE}
select repo, file, package, installed as version from n where package <> '' and installed <> ''"""
ORACLES["ingest_ai_review"] = f"""{ctes('ai_answers')}, flat as (
 select *, cast(null as bigint) as line, 'none' as rule, 'CWE-999' as cwe, 'medium' as severity, 'AI detected security vulnerability' as description from ai_answers)
select repo, file, ord % 40 as line, concat('r', ord) as rule, 'CWE-89' as cwe, 'high' as severity, 'd' as description from flat where ord % 7 = 0
union all select repo, file, line, concat('r', ord), cwe, severity, description from flat where ord % 7 = 1
union all select repo, file, line, concat('ai-', provider), 'CWE-78', severity, description from flat where ord % 7 = 1
union all select repo, file, line, concat('solo', ord), cwe, 'low', description from flat where ord % 7 = 3
union all select repo, file, ord % 40, concat('ai-', provider), cwe, severity, description from flat where ord % 7 = 5"""
PR_EVENTS = """pr_events as (select ord, ts, coalesce(json_extract_string(body, '$.repository.full_name'), 'unknown/repo') as repo,
  coalesce(cast(json_extract_string(body, '$.number') as bigint), 1) as pr_number,
  coalesce(json_extract_string(body, '$.pull_request.head.sha'), 'unknown-sha') as commit_sha,
  coalesce(json_extract_string(body, '$.pull_request.head.ref'), 'main') as branch
 from pr_bodies where json_extract(body, '$.pull_request') is not null)"""
ORACLES["ingest_pr_event"] = f"""{ctes('pr_bodies')}, {PR_EVENTS} select ord, repo, pr_number, commit_sha, branch from pr_events"""

# --- Secrets --------------------------------------------------------------------------------

SECRET_PATTERNS = [
    ("aws", r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ASCA)[A-Z0-9]{16}\b", 0),
    ("github", r"\bghp_[A-Za-z0-9_]{36,255}\b", 0),
    ("openai", r"\bsk-(?:proj-)?[a-zA-Z0-9]{32,}\b", 0),
    ("anthropic", r"\bsk-ant-sid01-[a-zA-Z0-9_-]{93}\b", 0),
    ("google", r"\bAIza[0-9A-Za-z_-]{35}\b", 0),
    ("slack", r"\bxox[baprs]-[0-9]{10,12}-[a-zA-Z0-9]{24,48}\b", 0),
    ("jwt", r"\beyJ[A-Za-z0-9_=-]+\.eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\b", 0),
    ("ssh_key", r"-----BEGIN[A-Z0-9\s_]+PRIVATE\s+KEY-----", 0),
    ("db_url", r"\b(?:mongodb|postgres|postgresql|mysql|mssql|redis|sqlite|oracle)://[A-Za-z0-9_~%-]+:[A-Za-z0-9_~%-]+@[A-Za-z0-9.-]+:[0-9]+\b", 0),
    ("generic", r"(?i)\b(?:API_KEY|SECRET|PASSWORD|PASS|TOKEN|CREDENTIALS|PWD)\s*=\s*['\"]?([A-Za-z0-9_~!@#$%^&*()+-]{16,})['\"]?", 1),
]


def secret_sql(lines: str) -> str:
    """Rows (repo, file, line, provider, value) of accepted secrets from a line relation."""
    structs = ", ".join(
        f"{{'provider': '{p}', 'value': regexp_extract(text, {q(rx)}, {g})}}" for p, rx, g in SECRET_PATTERNS
    )
    share = "((length(value) - length(replace(value, c, ''))) / length(value))"
    entropy = f"""round(list_sum(list_transform(list_distinct(string_split(value, '')),
   lambda c: case when c = '' then 0.0 else -{share} * log2({share}) end)), 9)"""
    return f"""found as (select repo, file, line_no, text, unnest([{structs}]) as h from ({lines}) l),
 hits as (select repo, file, line_no as line, text, h.provider as provider, h.value as value from found where h.value <> ''),
 secrets as (select * from hits where provider <> 'generic' or {entropy} > 3.0)"""


SECRET_OUT = f"""select repo, file, line, case when provider = 'generic' then 'generic-secret-entropy' else concat(provider, '-secret-key') end as rule,
 provider, {mask('value', 'provider')} as secret,
 case when provider = 'generic' then 'Detected high-entropy credential assignment in .env file or configuration.'
  else concat('Detected hardcoded ', upper(provider), ' access key/secret.') end as description from secrets"""


def secret_query(corpus: str) -> str:
    small = f"(select * from {corpus} where {SMALL})"
    return f"{ctes(corpus)}, {secret_sql(LINES.format(files=small))} {SECRET_OUT}"


ORACLES["secret_scan"] = secret_query("code_files")
ORACLES["secret_providers"] = secret_query("token_files")
ORACLES["stream_scan"] = secret_query("code_files")

# --- Dependencies ---------------------------------------------------------------------------

REQUIREMENTS = """deps as (select repo, file, cast(line_no as bigint) as line,
  lower(regexp_extract(trim(text), '^([a-zA-Z0-9_-]+)\\s*(?:==|<=|>=|~=|<|>)\\s*([a-zA-Z0-9.-]+)', 1)) as package,
  regexp_extract(trim(text), '^([a-zA-Z0-9_-]+)\\s*(?:==|<=|>=|~=|<|>)\\s*([a-zA-Z0-9.-]+)', 2) as version
 from requirement_lines where regexp_matches(trim(text), '^([a-zA-Z0-9_-]+)\\s*(?:==|<=|>=|~=|<|>)\\s*([a-zA-Z0-9.-]+)'))"""
ORACLES["deps_requirements"] = (
    f"{ctes('requirement_lines')}, {REQUIREMENTS} select repo, file, line, package, version from deps"
)


def pattern_deps(corpus: str, pattern: str, package: int, version: int, text: str) -> str:
    return f"""select repo, file, line_no as line, lower(regexp_extract({text}, {q(pattern)}, {package})) as package,
 regexp_extract({text}, {q(pattern)}, {version}) as version from ({LINES.format(files=corpus)}) l where regexp_matches({text}, {q(pattern)})"""


TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
DEPS_SQL: dict[str, tuple[str, str]] = {}
DEPS_SQL["deps_gemfile"] = ("gemfile_files", pattern_deps(
    "gemfile_files", r"^\s{4}([a-zA-Z0-9_-]+)\s*\(([\d.]+)\)", 1, 2, "text"))
DEPS_SQL["deps_pnpm"] = ("pnpm_files", pattern_deps(
    "pnpm_files", r"^/([a-zA-Z0-9_-]+)/([\d.]+)(?::)?$", 1, 2, TRIM))
DEPS_SQL["deps_gradle"] = ("gradle_files", pattern_deps(
    "gradle_files", r"""['"]([a-zA-Z0-9.-]+):([a-zA-Z0-9.-]+):([a-zA-Z0-9.-]+)['"]""", 2, 3, "text"))

# Block formats: per closing or version line, look back with correlated window expressions.
DEPS_SQL["deps_pom"] = ("pom_files", f"""select repo, file, start as line, lower(artifact) as package, version from (
  select repo, file, line_no, closes, start, last_close, last_value(a ignore nulls) over w as artifact, last_value(v ignore nulls) over w as version
  from (select *, last_value(case when opens then line_no end ignore nulls) over u as start,
     max(case when closes then line_no end) over (partition by repo, file order by line_no rows between unbounded preceding and 1 preceding) as last_close,
     sum(case when opens then 1 else 0 end) over u as block
    from (select repo, file, line_no, contains(text, '<dependency>') as opens,
       not contains(text, '<dependency>') and contains(text, '</dependency>') as closes,
       case when contains(text, 'dependency>') then null else nullif(regexp_extract(text, '<artifactId>(.*?)</artifactId>', 1), '') end as a,
       case when contains(text, 'dependency>') then null else nullif(regexp_extract(text, '<version>(.*?)</version>', 1), '') end as v
      from ({LINES.format(files='pom_files')}) l)
    window u as (partition by repo, file order by line_no))
  window w as (partition by repo, file, block order by line_no))
 where closes and start > coalesce(last_close, 0) and artifact is not null and version is not null""")
DEPS_SQL["deps_go_mod"] = ("go_files", f"""select repo, file, line, lower(string_split(module, '/')[-1]) as package, version from (
  select repo, file, line_no as line, case when single then words[2] else words[1] end as module,
   case when single then words[3] else words[2] end as version
  from (select *, last_value(flag ignore nulls) over (partition by repo, file order by line_no) as inside
   from (select repo, file, line_no, t, list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '') as words,
      starts_with(t, 'require ') and not starts_with(t, 'require (') as single,
      case when starts_with(t, 'require (') then true when starts_with(t, ')') then false end as flag
     from (select repo, file, line_no, {TRIM} as t from ({LINES.format(files='go_files')}) l)))
  where flag is null and ((single and len(words) >= 3) or (not single and inside and len(words) >= 2)))""")


def package_block_sql(corpus: str) -> str:
    value = "replace(trim(string_split(t, '=')[-1]), '\"', '')"
    return f"""select repo, file, coalesce(start, 1) as line, lower(name) as package, {value} as version from (
  select repo, file, line_no, t, start, last_value(case when starts_with(t, 'name = ') then {value} end ignore nulls)
    over (partition by repo, file, block order by line_no) as name
  from (select *, sum(case when t = '[[package]]' then 1 else 0 end) over u as block,
     last_value(case when t = '[[package]]' then line_no end ignore nulls) over u as start
    from (select repo, file, line_no, {TRIM} as t from ({LINES.format(files=corpus)}) l)
    window u as (partition by repo, file order by line_no)))
 where starts_with(t, 'version = ') and coalesce(name, '') <> ''"""


DEPS_SQL["deps_cargo"] = ("cargo_files", package_block_sql("cargo_files"))
DEPS_SQL["deps_poetry"] = ("poetry_files", package_block_sql("poetry_files"))
DEPS_SQL["deps_yarn"] = ("yarn_files", f"""select repo, file, line_no as line, lower(name) as package,
  replace(trim(string_split(t, 'version')[-1]), '"', '') as version from (
  select repo, file, line_no, t, last_value(case when t like '%:' then string_split(replace(string_split(t, '@')[1], '"', ''), '/')[-1] end ignore nulls)
    over (partition by repo, file order by line_no) as name
  from (select repo, file, line_no, {TRIM} as t from ({LINES.format(files='yarn_files')}) l) where t <> '' and not starts_with(t, '#'))
 where starts_with(t, 'version ') and not t like '%:' and coalesce(name, '') <> ''""")


def members(json: str) -> str:
    """List of (k, v) with the version of each member of a JSON object."""
    return f"list_transform(map_entries(cast({json} as map(varchar, json))), lambda e: {{'k': e.key, 'v': json_extract_string(e.value, '$.version')}})"


DEPS_SQL["deps_package_lock"] = ("package_lock_files", f"""select repo, file, cast(1 as bigint) as line, lower(name) as package, version from (
  select repo, file, case when modern then string_split(e.k, 'node_modules/')[-1] else e.k end as name, e.v as version from (
   select repo, file, modern, unnest({members('obj')}) as e from (
    select repo, path as file, len(json_keys(content, '$.packages')) > 0 as modern,
     case when len(json_keys(content, '$.packages')) > 0 then json_extract(content, '$.packages') else json_extract(content, '$.dependencies') end as obj
    from package_lock_files)))
 where name <> '' and version <> ''""")
DEPS_SQL["deps_composer"] = ("composer_files", """select repo, file, cast(1 as bigint) as line, lower(string_split(name, '/')[-1]) as package, version from (
  select repo, file, json_extract_string(e, '$.name') as name, json_extract_string(e, '$.version') as version from (
   select repo, path as file, unnest(from_json(json_extract(content, '$.packages'), '["JSON"]')) as e from composer_files)) where version <> ''""")
DEPS_SQL["deps_pipfile"] = ("pipfile_files", f"""select repo, file, cast(1 as bigint) as line, lower(e.k) as package, replace(e.v, '==', '') as version from (
  select repo, file, unnest({members('obj')}) as e from (
   select repo, path as file, json_extract(content, '$.default') as obj from pipfile_files
   union all select repo, path as file, json_extract(content, '$.develop') as obj from pipfile_files)) where e.v <> ''""")
for _key, (_corpus, _sql) in DEPS_SQL.items():
    ORACLES[_key] = f"{ctes(_corpus)} {_sql}"
ALL_DEPS = "\n union all ".join(f"select * from ({sql})" for _, sql in DEPS_SQL.values())
ALL_CORPORA = ctes(*[corpus for corpus, _ in DEPS_SQL.values()])
ORACLES["extract_deps"] = f"{ALL_CORPORA} {ALL_DEPS}"

VULN = values(
    "vuln", "package, affected, cve, severity, fixed, a, b, c",
    [
        [q(p), q(a), q(c), q(s), q(f), *f.split(".")]
        for p, a, c, s, f in VULNERABILITIES
    ],
)
# All constraints of the table are '<'; a version is its first three numbers before - or +.
SCA = f"""{VULN},
 parts as (select *, list_transform(regexp_extract_all(string_split(string_split(regexp_replace(version, '^v', ''), '-')[1], '+')[1], '(\\d+)'),
   lambda d: cast(d as bigint)) as nums from deps),
 sca as (select p.repo, p.file, p.line, p.package, p.version as installed, v.affected, v.cve, v.severity, v.fixed
  from parts p join vuln v on v.package = p.package
  where len(nums) > 0 and [coalesce(nums[1], 0), coalesce(nums[2], 0), coalesce(nums[3], 0)] < [v.a, v.b, v.c])"""
ORACLES["sca_match"] = f"""{ctes('requirement_lines')}, {REQUIREMENTS}, {SCA}
select repo, file, line, concat('sca-', package) as rule, severity, package, installed, affected, cve,
 concat('Upgrade dependency to version ', fixed, ' or later') as fix,
 concat('Vulnerable dependency ', package, ' (', installed, ') matched constraint ', affected, '. CVE: ', cve, '.') as description from sca"""

_NUMS = "list_transform(list_slice(regexp_extract_all({}, '(\\d+)'), 1, 3), lambda d: cast(d as bigint))"
_THREE = "[coalesce(nums[1], 0), coalesce(nums[2], 0), coalesce(nums[3], 0)]"
ORACLES["sca_match_ranges"] = f"""{ctes('requirement_lines', 'advisories')}, {REQUIREMENTS},
 parts as (select *, {_THREE} as have from (
  select *, {_NUMS.format("string_split(string_split(regexp_replace(version, '^v', ''), '-')[1], '+')[1]")} as nums from deps) where len(nums) > 0),
 ranges as (select *, {_THREE} as bound from (
  select *, regexp_extract(trim(affected), '^([<>=]+)\\s*([\\d.]+)', 1) as op,
   {_NUMS.format("regexp_extract(trim(affected), '^([<>=]+)\\s*([\\d.]+)', 2)")} as nums from advisories))
select p.repo, p.file, p.line, r.severity, p.package, p.version as installed, r.affected, r.cve, r.fix from parts p join ranges r on r.package = p.package
 where case op when '<' then have < bound when '<=' then have <= bound when '>' then have > bound when '>=' then have >= bound when '==' then have = bound else false end"""

# --- Configuration --------------------------------------------------------------------------


def config_predicate(rule: cr.ConfigRule) -> str:
    tests = [f"contains(text, {q(c)})" for c in rule.contains]
    if rule.any_regex:
        tests.append("(" + " or ".join(f"regexp_matches(text, {q(r.replace('(?U)', ''))})" for r in rule.any_regex) + ")")
    if rule.skip_comments:
        tests.append("not starts_with(trim(text), '#')")
    return " and ".join(tests)


def config_sql(relation: str, rules: list[cr.ConfigRule]) -> str:
    return " union all ".join(
        f"""select repo, file, cast(line_no as bigint) as line, {q(r.rule)} as rule, {q(r.cwe)} as cwe, {q(r.severity)} as severity,
 {q(r.description)} as description, {q(r.remediation)} as rule_remediation from {relation} where {config_predicate(r)}"""
        for r in rules
    )


for _key, _kind in {
    "iac_compose": "compose", "iac_terraform": "terraform", "iac_kubernetes": "kubernetes",
    "iac_cloudformation": "cloudformation", "iac_github_actions": "github-actions", "iac_gitlab": "gitlab",
    "iac_jenkins": "jenkins",
}.items():
    ORACLES[_key] = (
        f"{ctes('config_lines')}, mine as (select * from config_lines where kind = {q(_kind)}) "
        + config_sql("mine", [r for r in cr.CONFIG_RULES if r.kind == _kind])
    )
DOCKER = f"""docker_lines as ({LINES.format(files='docker_files')}),
 users as (select repo, file, max(line_no) as line, arg_max(trim(string_split(text, 'USER')[-1]), line_no) as name
  from docker_lines where starts_with(trim(text), 'USER ') group by repo, file),
 docker_found as (
 {config_sql('docker_lines', [r for r in cr.CONFIG_RULES if r.kind == 'dockerfile'])}
 union all select d.repo, d.path, coalesce(u.line, 1), {q(cr.ROOT_RULE)}, {q(cr.ROOT_CWE)}, {q(cr.ROOT_SEVERITY)},
  case when u.repo is null then {q(cr.NO_USER[0])} else {q(cr.ROOT_USER[0])} end,
  case when u.repo is null then {q(cr.NO_USER[1])} else {q(cr.ROOT_USER[1])} end
  from docker_files d left join users u on u.repo = d.repo and u.file = d.path
  where u.repo is null or lower(u.name) = 'root' or u.name = '0')"""
ORACLES["iac_dockerfile"] = f"{ctes('docker_files')}, {DOCKER} select * from docker_found"

# --- Joins and texts ------------------------------------------------------------------------

FINDINGS = ctes("findings")
CWE_DIM = values("cwe_dim", "n, title, description", [[str(n), q(t), q(d)] for n, t, d in wk.CWE_TEXTS])
ORACLES["cwe_enrich"] = f"""{FINDINGS}, {CWE_DIM},
 f as (select ord, upper(trim(case when ord % 11 = 0 then 'CWE-99999' when ord % 13 = 0 then 'weird' when ord % 17 = 0 then ' cwe-79 ' else cwe end)) as id from findings)
select ord, case when d.n is not null then d.title when starts_with(id, 'CWE-') then concat(id, ' Vulnerability') else id end as cwe_title,
 case when d.n is not null then d.description when starts_with(id, 'CWE-') then {q(wk.NOT_FOUND)} else {q(wk.UNKNOWN_ID)} end as cwe_description
from f left join cwe_dim d on concat('CWE-', d.n) = id"""
ORACLES["cwe_enrich_catalog"] = f"""select l_orderkey, l_linenumber,
 case when l_orderkey % 5 = 0 then concat('CWE-1000', l_partkey, ' Vulnerability') when p_partkey % 7 = 0 then concat('CWE-', p_partkey, ' Definition')
  else concat('Weak <', p_name, '> & "', p_partkey, '"') end as cwe_title,
 case when l_orderkey % 5 = 0 then {q(wk.NOT_FOUND)} when p_partkey % 11 = 0 then {q(wk.NO_DESCRIPTION)}
  else concat('Entry of ', p_name, ' & <others>') end as cwe_description
from lineitem join part on p_partkey = l_partkey"""
ADVICE = "case cwe " + " ".join(f"when {q(c)} then {q(t)}" for c, t in wk.GUIDANCE.items()) + f" else {q(wk.DEFAULT_GUIDANCE)} end"
ORACLES["remediation_join"] = f"{FINDINGS} select ord, cwe, {ADVICE} as remediation from findings"


def template_case(field: str) -> str:
    whens = " ".join(f"when {q(c)} then {body(t[field])}" for c, t in tp.TEMPLATES.items())
    return f"case cwe {whens}"


def flow_text(t: dict) -> str:
    return "\n".join(
        f"{i + 1}|{tp.STEP_TYPES[i]}|{label}|{code}|{text}" for i, (label, code, text) in enumerate(t["flow"])
    )


_F = tp.FALLBACK
_GIVEN = "nullif(sink, '')"
_FLOW_FALLBACK = "concat_ws(chr(10), " + ", ".join(
    f"concat('{i + 1}|{tp.STEP_TYPES[i]}|', {q(label)}, '|', coalesce({_GIVEN}, {q(code)}), '|', replace({q(text)}, '{{cwe}}', cwe))"
    for i, (label, code, text) in enumerate(_F["flow"])
) + ")"
ORACLES["template_join"] = f"""{FINDINGS}, f as (select ord, cwe, case when ord % 3 = 0 then '' else concat('code ', ord) end as sink from findings)
select ord,
 {template_case('why')} else replace({q(_F['why'])}, '{{cwe}}', cwe) end as t_why,
 {template_case('source')} else {q(_F['source'])} end as t_source,
 {template_case('sink')} else coalesce({_GIVEN}, {q(_F['sink'])}) end as t_sink,
 {template_case('exploit')} else {q(_F['exploit'])} end as t_exploit,
 {template_case('cwe')} else replace({q(_F['cwe'])}, '{{cwe}}', cwe) end as t_cwe,
 {template_case('fix_desc')} else {q(_F['fix_desc'])} end as t_fix_desc,
 {template_case('original_code')} else coalesce({_GIVEN}, {q(_F['original_code'])}) end as t_original_code,
 {template_case('secure_code')} else concat('# Secured replacement code', chr(10), coalesce({_GIVEN}, 'pass')) end as t_secure_code,
 case cwe {" ".join(f"when {q(c)} then {body(flow_text(t))}" for c, t in tp.TEMPLATES.items())} else {_FLOW_FALLBACK} end as t_flow
from f"""

LOCATED = f"""finding_lines as ({LINES.format(files='finding_files')}),
 located as (select f.*, coalesce(trim(l.text), '') as sink from findings f
  left join finding_lines l on l.repo = f.repo and l.file = f.file and l.line_no = f.line)"""


def print_sql(relation: str) -> str:
    return f"""(select *, sha256(concat(repo, ':', repo, '/', file, ':', cwe, ':', sink, ':', case when code = '' then concat('line-', coalesce(cast(line as varchar), 'None')) else code end)) as fingerprint
 from (select *, lower(regexp_replace(regexp_replace(regexp_replace(sink, '#.*$', ''), '//.*$', ''), '\\s', '', 'g')) as code from {relation}))"""


LOCATED_CTES = f"{ctes('findings', 'finding_files')}, {LOCATED}"
ORACLES["corpus_load"] = """select concat('repo', doc_id % 6) as repo,
 concat(case doc_id % 5 when 0 then '' when 1 then 'src/' when 2 then '.github/workflows/' when 3 then '_build/a/b/' else concat('p', doc_id % 11, '/') end,
  case when doc_id % 3 = 0 then '.' else 'd' end, doc_id, case doc_id % 4 when 0 then '.py' when 1 then '.env' when 2 then '' else '.yml' end) as path,
 (strlen(coalesce(text, '')) + case when doc_id % 9 = 0 then 2 else 0 end)::bigint as size, sha256(coalesce(text, '')) as content_sha256, true as read
from documents"""
ORACLES["sink_lookup"] = f"{LOCATED_CTES} select ord, sink from located"
ORACLES["sink_lookup_buckets"] = ORACLES["sink_lookup"]
ORACLES["fingerprint"] = f"{LOCATED_CTES} select ord, fingerprint from {print_sql('located')}"
ORACLES["finding_lookup"] = f"""{LOCATED_CTES}, marked as (select * from {print_sql('located')}),
 first as (select fingerprint, min(ord) as ord, arg_min(rule, ord) as rule, arg_min(cwe, ord) as cwe from marked group by fingerprint)
select m.ord as request_id, f.ord, f.rule, f.cwe from marked m join first f on f.fingerprint =
 case when m.ord % 9 = 0 then sha256(cast(m.ord as varchar)) else m.fingerprint end"""
ORACLES["reachability"] = f"""{ctes('requirement_lines', 'import_files')}, {REQUIREMENTS}, {SCA},
 seen as (select distinct s.repo, s.package from (select distinct repo, package from sca) s join import_files i on i.repo = s.repo
  where {EXT} in {ql(config.REACHABILITY_EXTENSIONS)} and contains(lower(i.content), s.package))
select s.repo, s.line, s.package, case when n.package is null then 'NO' else 'YES' end as reachable
from sca s left join seen n on n.repo = s.repo and n.package = s.package"""
ORACLES["reachability_postings"] = ORACLES["reachability"]
EXPOSED = " or ".join(f"contains(lower(content), {q(m)})" for m in config.EXPOSURE_MARKERS)
ORACLES["exposure"] = f"""{ctes('code_files', 'finding_files', 'mixed_files')},
 f as (select repo, path, content from code_files union all select repo, path, content from finding_files
  union all select concat('x', repo), path, content from mixed_files)
select repo, bool_or(({EXT} in {ql(config.EXPOSURE_EXTENSIONS)} or {NAME} = 'dockerfile') and ({EXPOSED})) as internet_exposed from f group by repo"""
PATCHED = """p as (select d.repo, d.path, d.content, string_split(d.content, chr(10)) as parts, x.ord, x.line, x.original_code, x.new_code,
   trim(x.original_code) as wanted from docker_files d join patches x on x.repo = d.repo and x.file = d.path),
 s as (select *, line between 1 and len(parts) and (original_code = '' or contains(trim(parts[line]), wanted) or contains(wanted, trim(parts[line]))) as by_line,
   original_code <> '' and contains(content, wanted) as by_text from p),
 patched as (select repo, path, ord, case when by_line then 'line' when by_text then 'text' else 'failed' end as status,
  case when by_line then concat(array_to_string(list_concat(parts[:line - 1], [new_code], parts[line + 1:]), chr(10)), chr(10))
   else replace(content, wanted, trim(new_code)) end as content from s)"""
ORACLES["patch_apply"] = f"""{ctes('docker_files', 'patches')}, {PATCHED}
select repo, path, cast(strlen(content) as bigint) as size, content from patched where status <> 'failed'"""
ORACLES["patch_lines"] = f"""{ctes('patched_files', 'line_patches')},
 parts as (select repo, path, string_split(content, chr(10)) as l from patched_files),
 lines as (select repo, path, unnest(l) as t, unnest(range(1, len(l) + 1)) as n from parts),
 edits as (select repo, file, line, arg_max(new_code, ord) as t from line_patches where line < 1000000 group by repo, file, line),
 merged as (select lines.repo, path, concat(string_agg(coalesce(e.t, lines.t), chr(10) order by n), chr(10)) as content
  from lines left join edits e on e.repo = lines.repo and e.file = path and e.line = n group by lines.repo, path having count(e.t) > 0)
select repo, path, cast(strlen(content) as bigint) as size, content from merged"""
ORACLES["patch_lines_status"] = f"""{ctes('patched_files', 'line_patches')}
select p.repo, p.file, p.ord, case when f.path is not null and line < 1000000 then 'line' else 'failed' end as status
from line_patches p left join patched_files f on f.repo = p.repo and f.path = p.file"""
ORACLES["patch_status"] = f"{ctes('docker_files', 'patches')}, {PATCHED} select repo, path as file, ord, status from patched"

# --- Deduplication, scoring, gate -----------------------------------------------------------


def detector(rule: str, kind: str) -> str:
    r, t = f"lower(coalesce({rule}, ''))", f"upper(coalesce({kind}, ''))"
    model = f"case when starts_with({r}, 'ai-') then string_split({r}, 'ai-')[-1] else {r} end"
    return f"""case when starts_with({r}, 'ast-') then 'AST' when starts_with({r}, 'bandit-') then 'Bandit' when starts_with({r}, 'codeql-') then 'CodeQL'
 when {t} = 'SCA' or starts_with({r}, 'sca-') then 'SCA'
 when {t} = 'SECRET' or ends_with({r}, '-secret-key') or {r} = 'gitleaks-secret' then 'SecretScanner' when {t} = 'IAC' then 'IaCScanner'
 when starts_with({r}, 'ai-') or regexp_matches({r}, 'openai|claude|ollama|cursor') then
  case when contains({model}, 'openai') then 'AI (OpenAI)' when contains({model}, 'claude') then 'AI (Claude)'
   when contains({model}, 'ollama') then 'AI (Ollama)' when contains({model}, 'cursor') then 'AI (Cursor)' else 'AI' end
 when contains({r}, 'ai') then 'AI' else 'AST' end"""


PRIORITY = "case lower(coalesce(severity, 'low')) when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end"
MISS = "case d " + " ".join(f"when {q(n)} then cast({1.0 - c!r} as double)" for n, c in DETECTOR_CONFIDENCE.items()) + " else cast(0.4 as double) end"


def dedup_sql(relation: str, kind: str = "null", order: str = "ord", extra: str = "") -> str:
    """CTEs sets and deduped over a relation with the finding columns."""
    return f"""named as (select *, {detector('rule', kind)} as detector, row_number() over (partition by repo, file, line, cwe
   order by {PRIORITY} desc, length(coalesce(description, '')) desc, {order}) as place from {relation}),
 sets as (select repo, file, line, cwe, list_sort(list(distinct detector)) as names, count(*) as reports from named group by all),
 confident as (select *, cast(round_even((cast(1 as double) - list_reduce(list_transform(names, lambda d: {MISS}), lambda x, y: x * y, cast(1 as double))) * 100, 0) as bigint) as confidence from sets),
 deduped as (select n.*, array_to_string(s.names, ',') as detected_by, s.confidence, s.reports from named n
  join confident s on s.repo = n.repo and s.file = n.file and s.line is not distinct from n.line and s.cwe = n.cwe where n.place = 1)"""


DEDUP = f"{FINDINGS}, {dedup_sql('findings')}"
ORACLES["dedup_findings"] = f"""{DEDUP} select repo, file, cast(line as bigint) as line, cwe, ord, rule, severity, description, detected_by,
 confidence, reports from deduped"""
ORACLES["detector_set"] = f"""{FINDINGS}, changed as (select ord, repo, file, line, cwe, severity, description,
 case ord % 10 when 0 then 'gitleaks-secret' when 1 then 'chain-check' when 2 then 'ai-custom' when 3 then 'AI-Cursor-x' when 4 then 'my-ollama' else rule end as rule,
 case ord % 8 when 0 then 'SECRET' when 1 then 'iac' when 2 then 'SCA' end as kind from findings), {dedup_sql('changed', 'kind')}
select repo, file, cast(line as bigint) as line, cwe, array_to_string(names, ',') as detected_by from sets"""
ORACLES["combined_confidence"] = f"{DEDUP} select repo, file, cast(line as bigint) as line, cwe, confidence from confident"
CVSS = "case cwe " + " ".join(f"when {q(c)} then {s}" for c, s in CVSS_BASE.items()) + " else 6.5 end"


def score_sql(relation: str) -> str:
    return f"""factors as (select *, cast({CVSS} as decimal(3,1)) as cvss,
  case when cwe in {ql(EXPLOIT_HIGH)} then 'HIGH' when cwe in {ql(EXPLOIT_MEDIUM)} then 'MEDIUM' else 'LOW' end as exploitability from {relation}),
 rated as (select *, round(cvss * cast(case exploitability when 'HIGH' then 1.0 when 'MEDIUM' then 0.85 else 0.7 end as decimal(3,2))
   * cast(case reachable when 'YES' then 1.0 else 0.5 end as decimal(2,1)) * cast(confidence as decimal(3,0))
   * cast(case internet_exposed when 'YES' then 1.0 else 0.7 end as decimal(2,1)) * cast(0.01 as decimal(3,2)), 1) as risk_score from factors),
 scored as (select * exclude (severity), case when risk_score >= 9 then 'critical' when risk_score >= 7 then 'high' when risk_score >= 4 then 'medium' else 'low' end as severity from rated)"""


SCORED = f"""{DEDUP}, flagged as (select *, case when coalesce(line, 0) % 3 = 1 then 'NO' else 'YES' end as reachable,
  case when repo in ('repo1', 'repo4', 'repo5', 'repo8') then 'YES' else 'NO' end as internet_exposed from deduped), {score_sql('flagged')}"""
ORACLES["risk_score"] = f"""{SCORED} select repo, file, cast(line as bigint) as line, cwe, cast(cvss as double) as cvss, exploitability,
 cast(risk_score as double) as risk_score, severity from scored"""
COUNTS = """counts as (select repo, count(*) filter (where severity = 'critical') as critical, count(*) filter (where severity = 'high') as high,
  count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity = 'low') as low from scored group by repo)"""
ORACLES["severity_counts"] = f"{SCORED}, {COUNTS} select * from counts"
_POLICY_CTES = ctes("policy_files", "policy_repos").removeprefix("with ")


def gate_sql(counts: str = "counts") -> str:
    """CTE verdicts from counts and resolved policies."""
    reason = "case when {n} > {l} then concat('{S} findings count (', {n}, ') exceeds threshold (', {l}, ')') end"
    limits = ", ".join(
        reason.format(n=s, l=l, S=s.upper())
        for s, l in [("critical", "0"), ("high", "high_limit"), ("medium", "medium_limit"), ("low", "low_limit")]
    )
    return f"""joined as (select coalesce(c.repo, r.repo) as repo, coalesce(critical, 0) as critical, coalesce(high, 0) as high,
   coalesce(medium, 0) as medium, coalesce(low, 0) as low, coalesce(fail_on, 'critical,high') as fail_on, coalesce(high_limit, 0) as high_limit,
   medium_limit, low_limit from {counts} c full join resolved r on r.repo = c.repo),
 reasoned as (select *, list_filter(list_concat([{limits}], list_transform(string_split(fail_on, ','), lambda s:
    case when lower(s) = 'medium' and medium_limit is null and medium > 0 then concat('Security policy fails on MEDIUM severity (', medium, ' found)')
     when lower(s) = 'low' and low_limit is null and low > 0 then concat('Security policy fails on LOW severity (', low, ' found)') end)),
   lambda x: x is not null) as reasons from joined),
 verdicts as (select repo, critical, high, medium, low, case when len(reasons) > 0 then 'SECURITY GATE FAILED' else 'PASS' end as gate_status,
  array_to_string(reasons, '; ') as gate_reasons from reasoned)"""


GATE = f"{SCORED}, {COUNTS}, {_POLICY_CTES}, {RESOLVED}, {gate_sql()}"
ORACLES["gate"] = f"{GATE} select * from verdicts"
ORACLES["report_summary"] = f"""{GATE},
 covered as (select repo, array_to_string(list_sort(list(distinct cwe)), ',') as covered_cwes from findings group by repo),
 kept as (select repo, count(*) as finding_count from scored group by repo)
select v.repo, coalesce(finding_count, 0) as finding_count, coalesce(covered_cwes, '') as covered_cwes,
 case when gate_status <> 'PASS' or covered_cwes is not null then 'high' else 'low' end as risk_level, gate_status
from verdicts v left join covered c on c.repo = v.repo left join kept k on k.repo = v.repo"""
ORACLES["dashboard_overview"] = f"""{SCORED}, o as (select repo, count(*) as total, count(*) filter (where severity in ('critical', 'high')) as critical_high,
  least(100, count(*) * 10) as risk_score from scored group by repo)
select *, case when risk_score > 70 then 'High' when risk_score > 30 then 'Medium' else 'Low' end as risk_level,
 case when risk_score > 70 then 'Requires immediate attention' when risk_score > 30 then 'Review findings' else 'Secure' end as risk_message from o"""
ORACLES["ranked_findings"] = f"""{FINDINGS}, f as (select ord, repo, rule, lower(coalesce(case ord % 10 when 0 then null when 1 then 'info' else severity end, 'low')) as sev from findings)
select *, row_number() over (partition by repo order by rank, ord) as position from (
  select ord, repo, cast(case sev when 'critical' then 0 when 'high' then 1 else 3 end as bigint) as rank, rule from f where sev in ('critical', 'high', 'low'))"""
ORACLES["finding_defaults"] = f"{FINDINGS} select ord, case when ord % 4 = 0 then concat('CVE-', ord) else 'N/A' end as cve, rule from findings"
ORACLES["finding_union"] = f"""{ctes('code_files', 'docker_files', 'requirement_lines', 'bandit_reports')},
 {secret_sql(LINES.format(files='(select * from code_files where size <= 10485760)'))}, {DOCKER}, {REQUIREMENTS}, {SCA},
 bandit as ({ORACLES['ingest_bandit'].split(ctes('bandit_reports') + ',', 1)[1].replace(' r as (', 'with r as (', 1)})
select repo, file, line, case when provider = 'generic' then 'generic-secret-entropy' else concat(provider, '-secret-key') end as rule,
  'CWE-798' as cwe, 'critical' as severity, 'SECRET' as type from secrets
union all select repo, file, line, rule, cwe, severity, 'IAC' from docker_found
union all select repo, file, line, concat('sca-', package), 'CWE-1104', severity, 'SCA' from sca
union all select repo, file, line, rule, cwe, severity, null from bandit"""
HISTORY = ctes("scan_history")
LATEST = f"""{HISTORY} select repo, ord, ts, status from (select *, row_number() over (partition by repo order by ts desc, ord desc) as n from scan_history) where n = 1"""
ORACLES["latest_scan"] = LATEST
ORACLES["stream_latest"] = LATEST
ORACLES["newest_first"] = f"{HISTORY} select repo, ord, status, row_number() over (partition by repo order by ts desc, ord desc) as position from scan_history"

# --- Exports --------------------------------------------------------------------------------

PURL_TYPE = """case when regexp_matches(lower(file), 'requirements\\.txt|poetry\\.lock|pipfile\\.lock') then 'pypi'
 when regexp_matches(lower(file), 'package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml') then 'npm'
 when regexp_matches(lower(file), 'pom\\.xml|build\\.gradle') then 'maven' when contains(lower(file), 'go.mod') then 'golang'
 when contains(lower(file), 'cargo.lock') then 'cargo' when contains(lower(file), 'gemfile.lock') then 'gem'
 when contains(lower(file), 'composer.lock') then 'composer' else 'generic' end"""
COMPONENTS = f"""components as (select *, concat('pkg:', {PURL_TYPE}, '/', package, '@', version) as purl from (
  select repo, package, version, arg_min(file, (file, line)) as file, min((file, line)) as place from deps where package <> '' and version <> '' group by repo, package, version))"""
ORACLES["sbom_components"] = f"""{ALL_CORPORA}, deps as ({ALL_DEPS}), {COMPONENTS} select repo, package, version, file, purl from components"""
STAMP = "2024-01-31T00:00:00Z"
SERIAL = f"""(select concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) from (select sha256(concat(repo, '|{STAMP}')) as h))"""


def elements(relation: str, part: int, json: str, order: str) -> str:
    place = f"row_number() over (partition by repo order by {order})"
    return f"""select repo, cast({part} as bigint) as part, {place} as place, concat(case when {place} = 1 then '' else ',' end, {json}) as line from {relation}"""


DEP_DOC = f"{ctes('requirement_lines')}, {REQUIREMENTS}, {COMPONENTS}, repos as (select distinct repo from deps)"
_ORDER = "place, package, version"
ORACLES["cyclonedx_export"] = f"""{DEP_DOC}
select repo, cast(0 as bigint) as part, cast(1 as bigint) as place, concat('{{"bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":"urn:uuid:', {SERIAL},
 '","version":1,"metadata":{{"timestamp":"{STAMP}","tools":{{"components":[{{"type":"application","name":"auditlake","version":"0.1.0"}}]}},"component":{{"type":"application","name":"', repo, '"}}}},"components":[') as line from repos
union all {elements('components', 1, "concat('{\"type\":\"library\",\"name\":\"', package, '\",\"version\":\"', version, '\",\"purl\":\"', purl, '\"}')", _ORDER)}
union all select repo, 2, 1, ']}}' from repos"""
_SPDX_ID = "replace(replace(replace(concat('SPDXRef-Package-', package, '-', version), '@', '-'), '/', '-'), '_', '-')"
_NONE = "NOASSERTION"
_PACKAGE_JSON = f"""concat('{{"name":"', package, '","SPDXID":"', {_SPDX_ID}, '","versionInfo":"', version, '","downloadLocation":"{_NONE}","filesAnalyzed":false,"licenseConcluded":"{_NONE}","licenseDeclared":"{_NONE}","copyrightText":"{_NONE}","externalRefs":[{{"referenceCategory":"PACKAGE-MANAGER","referenceType":"purl","referenceLocator":"', purl, '"}}]}}')"""
_RELATION_JSON = f"""concat('{{"spdxElementId":"SPDXRef-DOCUMENT","relatedSpdxElement":"', {_SPDX_ID}, '","relationshipType":"DESCRIBES"}}')"""
ORACLES["spdx_export"] = f"""{DEP_DOC}
select repo, cast(0 as bigint) as part, cast(1 as bigint) as place, concat('{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":"', repo,
 '","documentNamespace":"https://spdx.org/spdxdocs/', repo, '-', {SERIAL}, '","creationInfo":{{"created":"{STAMP}","creators":["Tool: auditlake-0.1.0"]}},"packages":[') as line from repos
union all {elements('components', 1, _PACKAGE_JSON, _ORDER)}
union all select repo, 2, 1, '],"relationships":[' from repos
union all {elements('components', 3, _RELATION_JSON, _ORDER)}
union all select repo, 4, 1, ']}}' from repos"""
_LEVEL = "case when lower(coalesce(severity, 'medium')) in ('critical', 'high') then 'error' when lower(severity) = 'low' then 'note' else 'warning' end"
SARIF = f"""{FINDINGS}, {CWE_DIM},
 results as (select ord, repo, rule as rule_id, {_LEVEL} as level, description as message, concat(repo, '/', file) as uri,
  cast(coalesce(line, 1) as bigint) as start_line from findings),
 firsts as (select repo, rule, min(ord) as ord, arg_min(cwe, ord) as cwe from findings group by repo, rule),
 rules as (select f.repo, f.ord, f.rule as rule_id, replace(f.rule, '-', '_') as name, concat(f.cwe, ': ', d.title) as short_description,
  d.description as full_description, concat('https://cwe.mitre.org/data/definitions/', d.n, '.html') as help_uri
  from firsts f join cwe_dim d on concat('CWE-', d.n) = f.cwe)"""
ORACLES["sarif_rules"] = f"{SARIF} select repo, rule_id, name, short_description, full_description, help_uri from rules"
ORACLES["sarif_results"] = f"{SARIF} select ord, repo, rule_id, level, message, uri, start_line, start_line as end_line from results"
_RULE_JSON = """concat('{"id":"', rule_id, '","name":"', name, '","shortDescription":{"text":"', short_description, '"},"fullDescription":{"text":"', full_description, '"},"helpUri":"', help_uri, '"}')"""
_RESULT_JSON = """concat('{"ruleId":"', rule_id, '","level":"', level, '","message":{"text":"', message, '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"', uri, '"},"region":{"startLine":', start_line, ',"endLine":', start_line, '}}}]}')"""
ORACLES["sarif_export"] = f"""{SARIF}, repos as (select distinct repo from findings)
select repo, cast(0 as bigint) as part, cast(1 as bigint) as place, '{{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemas/sarif-schema-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"auditlake","semanticVersion":"1.0.0","rules":[' as line from repos
union all {elements('rules', 1, _RULE_JSON, 'ord')}
union all select repo, 2, 1, ']}}}},"results":[' from repos
union all {elements('results', 3, _RESULT_JSON, 'ord')}
union all select repo, 4, 1, ']}}]}}' from repos"""
_FINDING_JSON = """concat('{"file":"', repo, '/', file, '",', case when line is null then '' else concat('"line":', line, ',') end, '"cwe":"', cwe, '","rule":"', rule, '","severity":"', severity, '","description":"', description, '"}')"""
ORACLES["report_export"] = f"""{FINDINGS}
select line, repo from (select concat('{{"source_path":"', repo, '","summary":{{"finding_count":', count(*), '}},"findings":[') as line, repo from findings group by repo
union all select line, repo from ({elements('findings', 1, _FINDING_JSON, 'ord')})
union all select ']}}', repo from (select distinct repo from findings))"""

# --- Reviews --------------------------------------------------------------------------------

_RUN = """case when gate_status = 'SECURITY GATE FAILED' or critical > 0 or high > 0"""
CHECK_COLUMNS = f"""{_RUN} then 'failure' else 'success' end as conclusion,
 {_RUN} then 'Security Gate Failed' else 'Security Gate Passed' end as title,
 concat(coalesce(critical, 0), ' Critical, ', coalesce(high, 0), ' High, ', coalesce(medium, 0), ' Medium, ', coalesce(low, 0), ' Low findings detected.') as summary"""
_PR_CTES = ctes("pr_bodies").removeprefix("with ")
ORACLES["pr_check_run"] = f"""{GATE}, {_PR_CTES}, {PR_EVENTS}
select ord, e.repo, pr_number, commit_sha, {CHECK_COLUMNS} from pr_events e left join verdicts v on v.repo = e.repo"""
ORACLES["stream_pr_events"] = f"""{GATE}, e as (select distinct concat('repo', user_id % 10) as repo, event_id % 50 as pr_number,
  concat('s', user_id) as commit_sha, 'main' as branch from events where event_id % 5 <> 0)
select e.repo, pr_number, commit_sha, branch, {CHECK_COLUMNS} from e left join verdicts v on v.repo = e.repo"""
SCANNED = f"""{ctes('pr_bodies', 'findings')}, {PR_EVENTS},
 newest as (select * from (select *, row_number() over (partition by repo, pr_number order by ts desc, ord desc) as n from pr_events) where n = 1),
 scanned as (select * from findings where repo in (select repo from pr_events))"""
ORACLES["pr_scan_join"] = f"""{SCANNED} select repo, pr_number, commit_sha, branch, n.findings from newest
 join (select repo, count(*) as findings from scanned group by repo) n using (repo)"""
FIX = "case cwe " + " ".join(f"when {q(c)} then {q(t['fix_desc'])}" for c, t in tp.TEMPLATES.items()) + f" else {q(tp.DEFAULT_ADVICE)} end"
ORACLES["pr_annotations"] = f"""{SCANNED} select repo, concat(repo, '/', file) as path, cast(coalesce(line, 1) as bigint) as start_line,
 cast(coalesce(line, 1) as bigint) as end_line, case when severity in ('critical', 'high') then 'failure' else 'warning' end as annotation_level,
 concat(cwe, ': ', rule) as title, concat(description, chr(10), chr(10), 'Suggested remediation:', chr(10), {FIX}) as message from scanned"""
ORACLES["pr_comments"] = f"""{SCANNED} select repo, concat(repo, '/', file) as file, cast(coalesce(line, 1) as bigint) as line,
 concat('### ⚠️ ', cwe, chr(10), chr(10), description, chr(10), chr(10), '**Suggested remediation:**', chr(10), {FIX}) as body from scanned"""

# --- Whole audit ----------------------------------------------------------------------------

_AUDIT_PARTS = ["import_files", "token_files", "docker_files", "pom_files", "pipfile_files"]
AUDIT = f"""{ctes(*_AUDIT_PARTS, 'bandit_reports', 'policy_files')},
 files as ({" union all ".join(f"select repo, path, size, content from {n}" for n in _AUDIT_PARTS)}),
 policy_repos as (select distinct repo from files), {RESOLVED},
 all_lines as ({LINES.format(files='files')}),
 secret_files as (select * from files where {KEPT} and ({SOURCE} or {NAME} = '.env' or {EXT} = '.env') and {SMALL}),
 {secret_sql(LINES.format(files='secret_files'))}, {DOCKER},
 deps as ({DEPS_SQL['deps_pom'][1]} union all {DEPS_SQL['deps_pipfile'][1]}), {SCA},
 bandit as ({ORACLES['ingest_bandit'].split(ctes('bandit_reports') + ',', 1)[1].replace(' r as (', 'with r as (', 1)}),
 every as (
  select repo, file, line, 'CWE-798' as cwe, case when provider = 'generic' then 'generic-secret-entropy' else concat(provider, '-secret-key') end as rule,
   'critical' as severity, 'SECRET' as kind, 3 as o1, list_position([{", ".join(q(p[0]) for p in SECRET_PATTERNS)}], provider) as o2,
   case when provider = 'generic' then 'Detected high-entropy credential assignment in .env file or configuration.'
    else concat('Detected hardcoded ', upper(provider), ' access key/secret.') end as description, null as package, null as cve from secrets
  union all select repo, file, line, cwe, rule, severity, 'IAC', 5, 0, description, null, null from docker_found
  union all select repo, file, line, 'CWE-1104', concat('sca-', package), severity, 'SCA', 4, 0,
   concat('Vulnerable dependency ', package, ' (', installed, ') matched constraint ', affected, '. CVE: ', cve, '.'), package, cve from sca
  union all select repo, file, line, cwe, rule, severity, null, 1, 0, description, null, null from bandit),
 raw as (select e.* from every e left join resolved r on r.repo = e.repo
  where case e.o1 when 3 then coalesce(r.scan_secrets, true) when 1 then coalesce(r.scan_sast, true) else true end),
 {dedup_sql('raw', 'kind', 'o1, o2')},
 seen as (select distinct w.repo, w.package from (select distinct repo, package from raw where package is not null) w join files i on i.repo = w.repo
  where {EXT} in {ql(config.REACHABILITY_EXTENSIONS)} and contains(lower(i.content), w.package)),
 exposed as (select distinct repo from files where ({EXT} in {ql(config.EXPOSURE_EXTENSIONS)} or {NAME} = 'dockerfile') and ({EXPOSED})),
 flagged as (select d.*, coalesce(l.sink, '') as sink,
   case when d.cwe = 'CWE-1104' and d.package is not null and n.package is null then 'NO' else 'YES' end as reachable,
   case when x.repo is null then 'NO' else 'YES' end as internet_exposed
  from deduped d left join (select repo, file, line_no, {TRIM} as sink from all_lines) l on l.repo = d.repo and l.file = d.file and l.line_no = d.line
  left join seen n on n.repo = d.repo and n.package = d.package left join exposed x on x.repo = d.repo),
 {score_sql('flagged')}"""
ORACLES["audit_findings"] = f"""{AUDIT} select repo, file, line, cwe, rule, detected_by, confidence, reachable, internet_exposed,
 cast(risk_score as double) as risk_score, severity, sink, fingerprint, coalesce(cve, 'N/A') as cve from {print_sql('scored')}"""
ORACLES["audit_verdicts"] = f"""{AUDIT}, {COUNTS}, {gate_sql()} select * from verdicts"""

ORACLES["stream_gate"] = f"""{ctes('code_files')}, {secret_sql(LINES.format(files='code_files'))},
 raw as (select repo, file, line, 'CWE-798' as cwe, 'generic-secret-entropy' as rule, 'critical' as severity, 'SECRET' as kind, '' as description, 1 as ord from secrets),
 {dedup_sql('raw', 'kind')},
 exposed as (select distinct repo from code_files where {EXPOSED}),
 flagged as (select d.*, 'YES' as reachable, case when x.repo is null then 'NO' else 'YES' end as internet_exposed from deduped d left join exposed x on x.repo = d.repo),
 {score_sql('flagged')}, {COUNTS},
 resolved as (select distinct repo, 'critical,high' as fail_on, 0 as high_limit, cast(null as int) as medium_limit, cast(null as int) as low_limit from code_files),
 {gate_sql()} select * from verdicts"""
ORACLES["stream_gate_changes"] = f"""with now_files as (select source as repo, concat('src/d', doc_id, '.py') as path, text as content from documents where doc_id % 3 = 2 or doc_id % 6 = 1),
 {secret_sql(LINES.format(files='now_files'))},
 raw as (select repo, file, line, 'CWE-798' as cwe, 'generic-secret-entropy' as rule, 'critical' as severity, 'SECRET' as kind, '' as description, 1 as ord from secrets
  union all select source, concat('m', doc_id, '/requirements.txt'), 1, 'CWE-1104', 'sca-django', 'high', 'SCA', '', 1 from documents where doc_id % 10 = 5 and doc_id % 15 <> 5),
 {dedup_sql('raw', 'kind')},
 exposed as (select distinct repo from now_files where {EXPOSED}),
 flagged as (select d.*, 'YES' as reachable, case when x.repo is null then 'NO' else 'YES' end as internet_exposed from deduped d left join exposed x on x.repo = d.repo),
 {score_sql('flagged')}, {COUNTS},
 resolved as (select distinct source as repo, 'critical,high' as fail_on, 0 as high_limit, cast(null as int) as medium_limit, cast(null as int) as low_limit from documents),
 {gate_sql()} select * from verdicts"""
