"""Permissions that code uses against those that its manifest declares; trust chains; content hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import digests

#: Fixed values: (category, expression, group, prefix), what code shows that it uses; without a group the value itself.
EXTRACTORS = (
    ("exec", r"(?:exec|execSync|spawn|spawnSync|fork)\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, ""),
    ("exec", r"child_process", None, "*"),
    ("exec", r"\$\(([^)]+)\)", 1, ""),
    ("exec", r"`([^`]+)`", 1, ""),
    ("network", r"https?://([a-zA-Z0-9.-]+)", 1, ""),
    ("network", r"fetch\s*\(\s*['\"`]https?://([^'\"`/]+)", 1, ""),
    ("network", r"axios\.[a-z]+\s*\(\s*['\"`]https?://([^'\"`/]+)", 1, ""),
    ("files", r"readFile(?:Sync)?\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, "read:"),
    ("files", r"readdir(?:Sync)?\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, "read:"),
    ("files", r"writeFile(?:Sync)?\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, "write:"),
    ("files", r"appendFile(?:Sync)?\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, "write:"),
    ("files", r"mkdir(?:Sync)?\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, "write:"),
    ("files", r"unlink(?:Sync)?\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, "delete:"),
    ("files", r"rm(?:Sync)?\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, "delete:"),
    ("secrets", r"((?:API_KEY|SECRET|TOKEN|PASSWORD|CREDENTIAL|AUTH)[A-Z_]*)", 1, ""),
    ("secrets", r"process\.env\.([A-Z_]+(?:KEY|SECRET|TOKEN|PASSWORD|AUTH)[A-Z_]*)", 1, ""),
    ("env", r"process\.env\.([A-Z_]+)", 1, ""),
    ("env", r"process\.env\[['\"`]([^'\"`]+)['\"`]\]", 1, ""),
)
CATEGORIES = ("exec", "network", "files", "secrets", "env")
#: Files of code that are looked at, and paths that aren't.
CODE = ("js", "ts", "mjs", "cjs", "jsx", "tsx", "py", "sh", "bash")
NOT_CODE = r"node_modules|\.git|\.min\.js$|\.map$|test/|tests/|__tests__/|\.test\.|\.spec\.|examples/|fixtures/"
#: Points for each permission of a category, for files by what is done, and for the general permission.
WEIGHTS = {"exec": 20, "network": 10, "files": 5, "secrets": 15, "env": 2}
FILE_WEIGHTS = {"write:": 15, "delete:": 25}
ANY_WEIGHTS = {"exec": 50, "network": 30, "files": 40, "secrets": 50, "env": 10}
#: Hosts that data is sent to by stealth, and commands that weigh in the risk.
SUSPICIOUS = ("webhook.site", "requestbin", "ngrok.io", "pipedream.net", "hookbin.com", "pastebin.com", "hastebin.com", "transfer.sh", "file.io")
DANGEROUS = ("rm", "curl", "wget", "eval")
#: Names of trust levels, those of known auditors, and levels by the kind of entity before the colon.
LEVELS = ("Self", "Community", "Organization", "Registry", "Official")
AUDITORS = {"clawdhub:official": 4, "clawdhub:verified": 3, "org:openclaw": 2, "org:acme-corp": 2}
KINDS = {"clawdhub": 1, "github": 1, "org": 2, "user": 1}
#: The manifest's version, and how long an audit is fresh.
VERSION, MONTH_DAYS, FRESH_MONTHS = "1.0", 30, 6


def is_code(path: Column) -> Column:
    """A file of code that is looked at for usage: no documentation, tests, examples or packages."""
    return T.extension(path).isin(*CODE) & ~path.rlike(NOT_CODE)


def used(content: Column) -> dict[str, Column]:
    """By category the sorted distinct permissions that the text shows."""

    def found(regex: str, group: int | None, prefix: str) -> Column:
        if group is None:
            return F.when(content.rlike(regex), F.array(F.lit(prefix))).otherwise(F.array().cast("array<string>"))
        return F.transform(F.regexp_extract_all(content, F.lit(regex), F.lit(group)), lambda x: F.concat(F.lit(prefix), x))

    return {k: F.array_sort(F.array_distinct(F.concat(*[found(*x[1:]) for x in EXTRACTORS if x[0] == k]))) for k in CATEGORIES}


def usage(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, category, permission) rows."""

    def pairs(category: str, permissions: Column) -> Column:
        return F.transform(permissions, lambda x: F.struct(F.lit(category).alias("category"), x.alias("permission")))

    every = F.concat(*[pairs(c, v) for c, v in used(F.col("content")).items()])
    return docs.select(key, F.explode(every).alias("p")).select(key, "p.*")


def glob_like(value: Column, pattern: Column) -> Column:
    """pattern with * for any text; its other characters stand for themselves."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"([.+?^$(){}|\[\]\\])", r"\\$1"), r"\*", ".*")
    return F.rlike(value, F.concat(F.lit("^"), body, F.lit("$")))


def command_allowed(value: Column, pattern: Column) -> Column:
    return (pattern == "*") | glob_like(value, pattern) | value.startswith(F.concat(pattern, F.lit(" ")))


def host_allowed(host: Column, pattern: Column) -> Column:
    domain = F.substring(pattern, F.lit(3), F.length(pattern))
    return (pattern == "*") | (host == pattern) | (pattern.startswith("*.") & ((host == domain) | F.endswith(host, F.concat(F.lit("."), domain))))


def file_allowed(value: Column, pattern: Column) -> Column:
    """mode:path each; the declared mode may be *, the declared path a start of the used one."""
    mode, path = F.split_part(value, F.lit(":"), F.lit(1)), F.regexp_replace(F.substring_index(value, ":", -1), r"^\./", "")
    mode_p, path_p = F.split_part(pattern, F.lit(":"), F.lit(1)), F.regexp_replace(F.substring_index(pattern, ":", -1), r"^\./", "")
    return ((mode == mode_p) | (mode_p == "*")) & (path_p.isin("", "*") | path.startswith(path_p) | glob_like(path, path_p))


def allowed(category: Column, use: Column, pattern: Column) -> Column:
    return (
        F.when(category == "exec", command_allowed(use, pattern)).when(category == "network", host_allowed(use, pattern))
        .when(category == "files", file_allowed(use, pattern)).otherwise(use == pattern)
    )


def severity() -> Column:
    c, use = F.col("category"), F.col("permission")
    suspicious = reduce(lambda a, b: a | b, [F.contains(use, F.lit(x)) for x in SUSPICIOUS])
    return (
        F.when(c == "exec", "high").when(c == "network", F.when(suspicious, "critical").otherwise("medium"))
        .when(c == "files", F.when(F.contains(use, F.lit("/etc")) | F.contains(use, F.lit("..")), "high").otherwise("low")).otherwise("medium")
    )


def _patterns(declared: DataFrame) -> Column:
    """declared(category, declared) as one literal array. A manifest is a small file, which the driver holds whole."""
    rows = declared.select("category", "declared").distinct().limit(MOST_DECLARED + 1).collect()
    if len(rows) > MOST_DECLARED:
        raise ValueError(f"a manifest declares {MOST_DECLARED} permissions at most")
    return F.array(*[F.struct(F.lit(c).alias("category"), F.lit(d).alias("declared")) for c, d in rows]) if rows else F.array().cast("array<struct<category:string,declared:string>>")


#: A manifest with more permissions is refused.
MOST_DECLARED = 2000


def _covered(declared: DataFrame) -> Column:
    return F.exists(_patterns(declared), lambda p: (p["category"] == F.col("category")) & allowed(F.col("category"), F.col("permission"), p["declared"]))


def undeclared(detected: DataFrame, declared: DataFrame) -> DataFrame:
    """Of detected(key.., category, permission) what no row of declared(category, declared) allows, with its severity and message."""
    out = detected.where(~_covered(declared)).withColumn("severity", severity())
    return out.withColumn("message", F.concat(F.lit("not declared: "), F.col("category"), F.lit(" "), F.col("permission")))


def matching(detected: DataFrame, declared: DataFrame) -> DataFrame:
    """Of detected what declared allows."""
    return detected.where(_covered(declared))


def unused(declared: DataFrame, detected: DataFrame) -> DataFrame:
    """Of declared what no detected permission calls for: each permission names the declared ones that allow it, and those never named are left."""
    allowing = F.filter(_patterns(declared), lambda p: (p["category"] == F.col("category")) & allowed(F.col("category"), F.col("permission"), p["declared"]))
    used_ones = detected.select(F.explode(allowing).alias("p")).select("p.category", "p.declared").distinct()
    return declared.join(used_ones, ["category", "declared"], "left_anti")


def verify(detected: DataFrame, declared: DataFrame, current_hash: str | None = None, expected_hash: str | None = None) -> DataFrame:
    """(kind, category, value) rows: undeclared and integrity are errors, unused and wildcard are warnings.

    Stricter than undeclared(): a permission is declared by itself, by the general one, files by their start and hosts by their domain.
    """
    rows = _patterns(declared)
    c, use = F.col("category"), F.col("permission")

    def declares(p: Column) -> Column:
        d = p["declared"]
        return (p["category"] == c) & (d.isin("*") | (d == use) | ((c == "files") & use.startswith(d)) | ((c == "network") & F.endswith(use, F.concat(F.lit("."), d))))

    missing = detected.where(~F.exists(rows, declares)).select(F.lit("undeclared").alias("kind"), c, use.alias("value")).distinct()
    left = declared.where("declared <> '*'").join(detected.select("category", F.col("permission").alias("declared")).distinct(), ["category", "declared"], "left_anti")
    out = missing.unionByName(left.select(F.lit("unused").alias("kind"), "category", F.col("declared").alias("value")))
    out = out.unionByName(declared.where("declared = '*'").select(F.lit("wildcard").alias("kind"), "category", F.col("declared").alias("value")))
    if expected_hash and current_hash != expected_hash:
        out = out.unionByName(declared.sparkSession.createDataFrame([("integrity", None, current_hash)], "kind string, category string, value string"))
    return out


def invalid(manifests: DataFrame, raw: str = "raw") -> DataFrame:
    """manifests with `errors`: what keeps each JSON text from being a manifest; an empty array if nothing does."""
    m = F.try_parse_json(raw)
    at = lambda path, kind="string": F.try_variant_get(m, path, kind)
    there = lambda path: at(path, "variant").isNotNull()
    kind = lambda path: F.schema_of_variant(at(path, "variant"))
    lists = ["exec", "network", "files", "tools", "secrets"]
    known = [*lists, "elevated"]
    checks = [
        (m.isNull(), "not JSON"),
        (~there("$.version"), "version is required"), (there("$.version") & ~F.coalesce(at("$.version") == VERSION, F.lit(False)), f"version must be {VERSION}"),
        (~there("$.permissions"), "permissions is required"), (there("$.permissions") & ~kind("$.permissions").startswith("OBJECT"), "permissions must be an object"),
        (F.coalesce(F.size(F.array_except(F.json_object_keys(at("$.permissions").cast("string")), F.array(*[F.lit(k) for k in known]))) > 0, F.lit(False)), "permissions has an unknown field"),
        *[(there(f"$.permissions.{k}") & ~kind(f"$.permissions.{k}").isin("ARRAY<STRING>", "ARRAY<VOID>"), f"permissions.{k} must be a list of texts") for k in lists],
        (there("$.permissions.elevated") & (kind("$.permissions.elevated") != "BOOLEAN"), "permissions.elevated must be true or false"),
        (there("$.trust.verified") & (kind("$.trust.verified") != "BOOLEAN"), "trust.verified must be true or false"),
        (there("$.risks.level") & ~F.coalesce(at("$.risks.level").isin("low", "medium", "high", "critical"), F.lit(False)), "risks.level is unknown"),
    ]
    return manifests.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(text)) for c, text in checks])))


def permission_scores(detected: DataFrame, *by: str) -> DataFrame:
    """Points by category, files by what is done to them and the general permission (*) counting for more, and the level they make."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    general = F.create_map(*[F.lit(x) for kv in ANY_WEIGHTS.items() for x in kv])
    c, use = F.col("category"), F.col("permission")
    points = F.when(use == "*", F.coalesce(general[c], F.lit(20)))
    for start, n in FILE_WEIGHTS.items():
        points = points.when((c == "files") & use.startswith(start), n)
    points = points.otherwise(F.coalesce(weight[c], F.lit(5)))
    out = detected.groupBy(*by).agg(F.sum(points).cast("long").alias("score"))
    return out.withColumn("level", F.when(F.col("score") < 20, "low").when(F.col("score") < 50, "medium").when(F.col("score") < 100, "high").otherwise("critical"))


def host(url: Column) -> Column:
    full = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def risk_level(commands: Column, hosts: Column, secrets: Column, elevated: Column) -> Column:
    bad_host = F.exists(hosts, lambda h: reduce(lambda a, b: a | b, [F.contains(h, F.lit(x)) for x in SUSPICIOUS]))
    points = F.when(elevated, 3).otherwise(0) + F.when(F.exists(commands, lambda c: c.isin(*DANGEROUS)), 2).otherwise(0) + F.when(bad_host, 3).otherwise(0) + F.when(F.size(secrets) > 3, 1).otherwise(0)
    return F.when(points >= 4, "critical").when(points >= 3, "high").when(points >= 1, "medium").otherwise("low")


def trust_level(entity: Column) -> Column:
    """Of an auditor: known ones by name, others by their kind."""
    by_name, by_kind = (F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in (AUDITORS, KINDS))
    return F.coalesce(by_name[entity], by_kind[F.split_part(entity, F.lit(":"), F.lit(1))], F.lit(0))


def trust(audits: DataFrame, by: str) -> DataFrame:
    """audits(by, auditor) to level (the highest) and score (the sum)."""
    level = trust_level(F.col("auditor"))
    return audits.groupBy(by).agg(F.max(level).cast("long").alias("level"), F.sum(level).cast("long").alias("score"), F.count("*").alias("audits"))


def trust_name(entity: Column) -> Column:
    kind, name = F.split_part(entity, F.lit(":"), F.lit(1)), F.split_part(entity, F.lit(":"), F.lit(2))
    shown = F.create_map(*[F.lit(x) for kv in {"clawdhub": "ClawdHub user: ", "github": "GitHub user: ", "org": "Organization: ", "user": "User: "}.items() for x in kv])
    known = F.create_map(*[F.lit(x) for kv in {"clawdhub:official": "ClawdHub Official", "clawdhub:verified": "ClawdHub Verified", "org:openclaw": "OpenClaw Team", "org:acme-corp": "Acme Corp."}.items() for x in kv])
    return F.coalesce(known[entity], F.concat(shown[kind], name), entity)


TRUST = "struct<author:string,audits:array<struct<auditor:string,date:string,contentHash:string,scope:string,notes:string>>,chain:array<string>,verified:boolean>"


def trust_chains(manifests: DataFrame, current_hash: Column | None = None, today: Column | None = None, trust_col: str = "trust") -> DataFrame:
    """manifests with trust_level, trust_score, verified, chain and warnings from their column `trust` (of type TRUST).

    The level is the highest of auditors and chain, the score the sum of author and auditors.
    Warnings are codes, with auditor and value: none (no trust at all), changed (content since an audit), old (audits beyond FRESH_MONTHS, in months) and
    unproven (a mark of verification without a registry's level).
    """
    t, today = F.col(trust_col), today if today is not None else F.current_date()
    audits, links = F.coalesce(t["audits"], F.array().cast("array<struct<auditor:string,date:string,contentHash:string,scope:string,notes:string>>")), F.coalesce(t["chain"], F.array().cast("array<string>"))
    author = F.when(t["author"] != "", t["author"])
    top = F.greatest(F.lit(0), F.array_max(F.transform(audits, lambda a: trust_level(a["auditor"]))), F.array_max(F.transform(links, trust_level)))
    score = F.coalesce(trust_level(author), F.lit(0)) + F.aggregate(audits, F.lit(0), lambda n, a: n + trust_level(a["auditor"]))
    entry = lambda entity, role, date: F.struct(entity.alias("entity"), F.lit(role).alias("role"), trust_level(entity).alias("level"), trust_name(entity).alias("name"), date.alias("date"))
    undated = F.lit(None).cast("string")
    chain = F.concat(F.when(author.isNotNull(), F.array(entry(author, "author", undated))).otherwise(F.array().cast("array<struct<entity:string,role:string,level:int,name:string,date:string>>")), F.transform(audits, lambda a: entry(a["auditor"], "auditor", a["date"])), F.transform(links, lambda x: entry(x, "chain", undated)))
    months = lambda a: F.datediff(today, F.try_to_date(a["date"])) / MONTH_DAYS
    changed = (lambda a: F.when(a["contentHash"] != current_hash, F.concat(F.lit("changed: "), a["auditor"], F.lit(", "), a["date"]))) if current_hash is not None else (lambda a: F.lit(None).cast("string"))
    old = lambda a: F.when(months(a) > FRESH_MONTHS, F.concat(F.lit("old: "), a["auditor"], F.lit(", "), F.floor(months(a)).cast("string")))
    by_audit = F.flatten(F.transform(audits, lambda a: F.array_compact(F.array(changed(a), old(a)))))
    verified = F.coalesce(t["verified"], F.lit(False))
    unproven = F.when(verified & (top < 3), F.array(F.lit("unproven"))).otherwise(F.array().cast("array<string>"))
    warnings = F.when(t.isNull(), F.array(F.lit("none"))).otherwise(F.concat(by_audit, unproven))
    return manifests.withColumns({
        "trust_level": F.when(t.isNull(), 0).otherwise(top), "trust_score": F.when(t.isNull(), 0).otherwise(score), "verified": verified,
        "chain": F.when(t.isNotNull(), chain), "warnings": warnings,
    })


def trust_text(level: Column, score: Column, verified: Column, chain: Column, warnings: Column) -> Column:
    """A trust chain as text, one line for each entry and warning."""
    name = F.get(F.array(*[F.lit(x) for x in LEVELS]), level)
    head = F.concat(F.lit("Trust level: "), name, F.lit(" (score: "), score.cast("string"), F.lit(")\nVerified: "), F.when(verified, "yes").otherwise("no"))
    entries = F.transform(chain, lambda x: F.concat(F.lit("\n  "), x["role"], F.lit(" "), x["name"], F.when(x["date"].isNotNull(), F.concat(F.lit(" ("), x["date"], F.lit(")"))).otherwise("")))
    return F.concat(head, F.array_join(entries, ""), F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("\n  ! "), w)), ""))


def audit_entry(auditor: Column, content_hash: Column, scope: str = "full", notes: str = "") -> Column:
    return F.struct(auditor.alias("auditor"), F.current_date().cast("string").alias("date"), content_hash.alias("contentHash"), F.lit(scope).alias("scope"), F.lit(notes).alias("notes"))


def front_matter(content: Column, field: str) -> Column:
    """A field of the block between the first two lines of dashes; null if there is none."""
    block = F.regexp_extract(content, r"^---\n([\s\S]*?)\n---", 1)
    found = F.trim(F.regexp_extract(block, field + r":\s*(.+)", 1))
    return F.when(found != "", found)


def usage_of_findings(findings: DataFrame, *by: str) -> DataFrame:
    """(by.., category, permission) that findings of a scan tell, by parts of the rule's id, from their snippets."""
    rule, snippet = F.col("rule_id"), F.coalesce("snippet", F.lit(""))
    of = lambda *parts: reduce(lambda a, b: a | b, [F.contains(rule, F.lit(p)) for p in parts])
    command = F.split_part(F.regexp_extract(snippet, r"(?:exec|spawn|system)\s*\(\s*['\"]([^'\"]+)", 1), F.lit(" "), F.lit(1))
    secret = F.coalesce(*[F.nullif(F.regexp_extract(snippet, r"process\.env\.(\w+)|getenv\(['\"](\w+)", k), F.lit("")) for k in (1, 2)])
    told = F.array(
        F.when(of("command", "exec"), F.struct(F.lit("exec").alias("category"), command.alias("permission"))),
        F.when(of("url", "http"), F.struct(F.lit("network").alias("category"), host(F.nullif(F.regexp_extract(snippet, r"https?://[^\s'\"]+", 0), F.lit(""))).alias("permission"))),
        F.when(of("credential", "secret"), F.struct(F.lit("secrets").alias("category"), secret.alias("permission"))),
        F.when(of("sudo", "elevated"), F.struct(F.lit("elevated").alias("category"), F.lit("true").alias("permission"))),
    )
    return findings.select(*by, F.explode(F.array_compact(told)).alias("t")).select(*by, "t.*").where("permission <> ''").distinct()


def generated(detected: DataFrame, *by: str) -> DataFrame:
    """A manifest for each group of detected(by.., category, permission): its distinct permissions, sorted, and the risk they make. A group is one skill."""
    held = lambda c: F.array_sort(F.collect_set(F.when(F.col("category") == c, F.col("permission"))))
    out = detected.groupBy(*by).agg(*[held(c).alias(c) for c in (*CATEGORIES, "elevated")])
    raised = F.size("elevated") > 0
    commands = F.transform("exec", lambda x: F.split_part(x, F.lit(" "), F.lit(1)))
    notes = F.array_compact(F.array(
        F.when(raised, F.lit("Runs with raised rights: look closely")), F.when(F.exists(commands, lambda c: c.isin("curl", "wget")), F.lit("Fetches content from elsewhere: check the sources")),
        F.when(F.size("secrets") > 0, F.concat(F.lit("Secrets in use: "), F.array_join("secrets", ", "))),
    ))
    return out.select(*by, F.lit(VERSION).alias("version"), F.struct(*CATEGORIES, raised.alias("elevated")).alias("permissions"), F.struct(risk_level(commands, F.col("network"), F.col("secrets"), raised).alias("level"), notes.alias("notes")).alias("risks"))


def initialised(files: DataFrame, by: str, path: str = "path", content: str = "content") -> DataFrame:
    """A manifest for each group of files(by, path relative to the group, content): name, description and author, permissions, risks and integrity.

    Name and description come from the block at the top of SKILL.md or else from
    package.json, which also tells the author (a text, or an object with a name).
    Of a group that holds either file twice the first content in order counts.
    """
    first = files.where(F.col(path).isin("SKILL.md", "package.json")).groupBy(by).agg(
        F.min(F.when(F.col(path) == "SKILL.md", F.col(content))).alias("_skill"), F.min(F.when(F.col(path) == "package.json", F.col(content))).alias("_package"),
    )
    package = F.from_json("_package", "name string, description string, author string")
    author = F.coalesce(F.get_json_object(package["author"], "$.name"), package["author"])
    told = first.select(
        F.col(by).cast("string").alias("_by"), F.coalesce(front_matter(F.col("_skill"), "name"), package["name"]).alias("name"),
        F.coalesce(front_matter(F.col("_skill"), "description"), package["description"]).alias("description"), author.alias("author"),
    )
    code = files.where(is_code(F.col(path)))
    made = generated(usage(code.withColumn("_key", F.col(by).cast("string")).select("_key", F.col(content).alias("content")), "_key"), "_key")
    hashes = digests.integrity(files, by, path, content).select(F.col(by).alias("_hashed"), F.struct(F.lit("sha256").alias("algorithm"), F.col("digest").alias("hash"), "files").alias("integrity"))
    groups = files.select(F.col(by).cast("string").alias(by)).distinct()
    out = groups.join(told, F.col(by).eqNullSafe(F.col("_by")), "left").join(made, F.col(by).eqNullSafe(F.col("_key")), "left").join(hashes, F.col(by).eqNullSafe(F.col("_hashed")), "left")
    return out.select(by, F.lit(VERSION).alias("version"), "name", "description", "author", "permissions", "risks", "integrity")


def integrity(files: DataFrame, *by: str, path: str = "path", content: str = "content", block: int = 10_000) -> DataFrame:
    """SHA-256 over the files' hashes in order of path, in two levels, so that no group of any size is gathered in one row.

    Files are numbered in order of path, `block` of them make a block with a hash over its files' hashes, and a group's hash is one over its blocks' hashes.
    """
    hashed = files.select(*by, F.col(path).alias("p"), F.sha2(F.col(content).cast("binary"), 256).alias("h"))
    # a path's number among those of its bucket, and the buckets are ranges of the path's first characters
    start = F.substring("p", 1, 48)
    ahead = hashed.groupBy(*by, start.alias("start")).count()
    before = ahead.withColumn("before", F.sum("count").over(W.partitionBy(*by).orderBy("start")) - F.col("count")).drop("count")
    within = F.row_number().over(W.partitionBy(*by, "start").orderBy("p", "h"))
    placed = hashed.withColumn("start", start).withColumn("within", within).join(before, [*by, "start"]).withColumn("k", F.floor((F.col("before") + F.col("within") - 1) / block))
    joined = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key))), lambda x: x["h"]), ""), 256)
    blocks = placed.groupBy(*by, "k").agg(joined(["p", "h"]).alias("h"), F.count("*").alias("n"))
    return blocks.groupBy(*by).agg(joined(["k", "h"]).alias("integrity"), F.sum("n").alias("files"))
