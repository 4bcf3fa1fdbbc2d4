"""Signature rules: named strings, and a condition on which of them are present, how often and in which order."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import dialect
from gleaner.operators import matcher


@dataclass(frozen=True)
class Text:
    var: str
    value: str
    kind: str = "text"  # or regex
    nocase: bool = False

    @property
    def prefix(self) -> str:
        return re.match(r"\$[A-Za-z]*", self.var)[0]


@dataclass(frozen=True)
class Signature:
    name: str
    meta: dict[str, str]
    strings: tuple[Text, ...]
    condition: Node


#: ("of", prefix, least count), ("count", string, comparison, number), ("not", node), ("and" or "or", nodes...), ("order", string, prefix): the string first stands before one of the prefix.
Node = tuple

_RULE = re.compile(r"rule\s+(\w+)[^{]*\{(.*?)\n\}", re.S)
_STRING = re.compile(r"(\$\w*)\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"|/((?:[^/\\\n]|\\.)+)/(i?))([^\n]*)")
_WORDS = re.compile(r"for\s+any\s+of\s*\(\s*\$\w*\*?\s*\)\s*:\s*\(\s*@\w+\s*<\s*@\s*\)|(?:any|all|\d+)\s+of\s+(?:\([^()]*\)|them)|[$#]\w+\*?|[<>=!]=?|\d+|and|or|not|[()]")
_OF = re.compile(r"(any|all|\d+)\s+of\s+(?:\(([^()]*)\)|them)")
_ORDER = re.compile(r"for\s+any\s+of\s*\(\s*(\$\w*)\*?\s*\)\s*:\s*\(\s*@(\w+)\s*<\s*@\s*\)")


def condition(text: str, strings: tuple[Text, ...]) -> Node:
    """What a condition asks: counts of strings and of their occurrences, joined by and, or, not. Anything else is refused."""
    words = _WORDS.findall(text)
    if re.sub(r"\s", "", "".join(words)) != re.sub(r"\s", "", text):
        raise ValueError(f"condition is not understood: {text.strip()}")
    at = 0

    def taken(*which: str) -> bool:
        nonlocal at
        if at < len(words) and words[at] in which:
            at += 1
            return True
        return False

    def joined(kind: str, part) -> Node:
        nodes = [part()]
        while taken(kind):
            nodes.append(part())
        return nodes[0] if len(nodes) == 1 else (kind, *nodes)

    def one() -> Node:
        nonlocal at
        if taken("not"):
            return ("not", one())
        if taken("("):
            inner = joined("or", lambda: joined("and", one))
            if not taken(")"):
                raise ValueError(f"bracket is open: {text.strip()}")
            return inner
        word = words[at]
        at += 1
        if m := _ORDER.fullmatch(word):
            return ("order", "$" + m[2], m[1])
        if m := _OF.fullmatch(word):
            parts = tuple(p.strip().rstrip("*") for p in m[2].split(",")) if m[2] else ("$",)
            n = sum(s.var.startswith(parts) for s in strings)
            return ("of", parts, {"any": 1, "all": n}.get(m[1]) or int(m[1]))
        if word.startswith("#"):
            at += 2
            return ("count", "$" + word[1:], words[at - 2], int(words[at - 1]))
        return ("count", word, ">=", 1)

    node = joined("or", lambda: joined("and", one))
    if at != len(words):
        raise ValueError(f"condition goes on: {text.strip()}")
    return node


def without_lookahead(regex: str) -> str:
    """The same test without (?!text) where `text` is plain: what follows differs from it at some character, or ends within it."""

    def spelled(m: re.Match) -> str:
        plain = re.sub(r"\\(.)", r"\1", m[1])
        quoted = [c if c.isalnum() else "\\" + c for c in plain]
        return "(?:" + "|".join("".join(quoted[:k]) + f"(?:[^{'' if c.isalnum() else chr(92)}{c}]|$)" for k, c in enumerate(plain)) + ")"

    return re.sub(r"\(\?!((?:[A-Za-z0-9_-]|\\[.\\/])+)\)", spelled, regex)


def parse(source: str) -> list[Signature]:
    """Rules of a signature file: meta, strings (text or regex, nocase) and the condition."""
    out = []
    for name, body in _RULE.findall(source):
        head, _, asked = body.partition("condition:")
        meta_part, _, strings_part = head.partition("strings:")
        meta = {k: v.strip('"') for k, v in re.findall(r"(\w+)\s*=\s*(\"[^\"]*\"|\w+)", meta_part)}
        strings = tuple(
            Text(var, without_lookahead(regex.replace(r"\/", "/")) if regex else text.encode().decode("unicode_escape"), "regex" if regex else "text", bool(flag) or "nocase" in rest) for var, text, regex, flag, rest in _STRING.findall(strings_part)
        )
        out.append(Signature(name, meta, strings, condition(asked, strings)))
    return out


def needs(text: Text) -> tuple[dialect.Clause, ...]:
    """Sets of literals, as dialect.normal() writes them, of each of which a text that holds this string has one; none where that isn't sure."""
    if not text.value.isascii() or not text.value:
        return ()
    if text.kind == "regex":
        # what Java reads otherwise than the parser does: intersections of sets, vertical space, numbers
        if re.search(r"&&|\\[v0-9]", text.value):
            return ()
        try:
            return dialect.needs(text.value, "i" if text.nocase else "")
        except re.error:
            return ()
    edges = [" " * c.isspace() for c in (text.value[0], text.value[-1])]
    return ((f"{edges[0]}{' '.join(text.value.lower().split())}{edges[1]}" if text.value.strip() else " ",),)


def named(content: Column, strings: Sequence[Text]) -> Column:
    """Numbers of the strings that a text may hold, as far as literals tell."""
    asked = tuple(map(needs, strings))

    def found(texts: pa.Array) -> pa.Array:
        return pa.array(matcher.named(texts, asked), pa.list_(pa.int32()))

    return F.arrow_udf(found, "array<int>")(content)


def present(text: Text, content: Column, lower: Column, may: Column | None = None) -> Column:
    """Whether a text holds a string; asked where it may."""
    if text.kind == "regex":
        held = content.rlike(("(?i)" if text.nocase else "") + text.value)
    else:
        held = F.contains(lower, F.lit(text.value.lower())) if text.nocase else F.contains(content, F.lit(text.value))
    return held if may is None else may & held


def holds(signature: Signature, content: Column, lower: Column, present: Callable[[Text], Column]) -> Column:
    def first(s: Text) -> Column:
        return F.regexp_instr(content, F.lit(("(?i)" if s.nocase else "") + s.value)) if s.kind == "regex" else F.locate(s.value.lower() if s.nocase else s.value, lower if s.nocase else content)

    def counted(s: Text) -> Column:
        quoted = s.value if s.kind == "regex" else "".join(c if c.isalnum() else "\\" + c for c in s.value)
        return F.regexp_count(content, F.lit(("(?i)" if s.nocase else "") + quoted))

    def test(node: Node) -> Column:
        kind, *args = node
        if kind in ("and", "or"):
            return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), [test(n) for n in args])
        if kind == "not":
            return ~test(args[0])
        if kind == "of":
            return reduce(lambda a, b: a + b, [present(s).cast("int") for s in signature.strings if s.var.startswith(args[0])], F.lit(0)) >= args[1]
        (named,) = [s for s in signature.strings if s.var == args[0]]
        if kind == "order":
            return first(named).between(1, F.greatest(F.lit(0), *[first(s) for s in signature.strings if s.var.startswith(args[1])]) - 1)
        if args[1:] == [">=", 1]:
            return present(named)
        n = counted(named)
        return {">": n > args[2], ">=": n >= args[2], "<": n < args[2], "<=": n <= args[2], "==": n == args[2], "!=": n != args[2]}[args[1]]

    return test(signature.condition)


def scan(docs: DataFrame, signatures: list[Signature], key: str = "doc_id") -> DataFrame:
    """(key, rule_id, severity, snippet): the first three strings present are the evidence; findings stand on line 0.

    One automaton over the literals of all strings names those that a text may hold; only they are looked for.
    """
    strings = list(dict.fromkeys(t for s in signatures for t in s.strings))
    number = {t: k for k, t in enumerate(strings)}
    matcher.workers_find_the_package(docs.sparkSession)
    docs = docs.withColumn("lower", F.lower("content")).withColumn("named", named(F.col("content"), strings))
    content, lower = F.col("content"), F.col("lower")

    def held(t: Text) -> Column:
        return present(t, content, lower, F.array_contains("named", F.lit(number[t])) if needs(t) else None)

    rows = []
    for s in signatures:
        shown = F.array_join(F.slice(F.array_compact(F.array(*[F.when(held(t), F.lit(t.value)) for t in s.strings])), 1, 3), ", ")
        rows.append(F.when(holds(s, content, lower, held), F.struct(F.lit(s.name).alias("rule_id"), F.lit(s.meta.get("severity", "warning")).alias("severity"), shown.alias("snippet"))))
    return docs.select(key, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(key, "r.*", F.lit(0).cast("long").alias("line"))


def read(spark: SparkSession, *paths: str) -> list[Signature]:
    """Rules of signature files, which are small."""
    return [r for p in paths for row in spark.read.text(p, wholetext=True).collect() for r in parse(row.value)]


def status(signatures: list[Signature], files: int = 0) -> dict[str, object]:
    return {"mode": "expressions", "files": files, "signatures": len(signatures)}


def _texts(var: str, *values: str, kind: str = "text", nocase: bool = True) -> tuple[Text, ...]:
    """$var1, $var2 and so on."""
    return tuple(Text(f"${var}{k}", without_lookahead(v) if kind == "regex" else v, kind, nocase) for k, v in enumerate(values, 1))


def _exact(var: str, *values: str) -> tuple[Text, ...]:
    return _texts(var, *values, nocase=False)


def _regex(var: str, *values: str, nocase: bool = False) -> tuple[Text, ...]:
    return _texts(var, *values, kind="regex", nocase=nocase)


def _signature(name: str, severity: str, category: str, asked: str, *groups: tuple[Text, ...]) -> Signature:
    strings = tuple(x for g in groups for x in g)
    return Signature(name, {"severity": severity, "category": category}, strings, condition(asked, strings))


#: Name, severity, category, condition and strings of each signature.
BUILT_IN = [
    _signature("PromptInjection_SystemOverride", "critical", "prompt_injection", "any of them",
        _texts("s", "ignore previous instructions", "ignore all previous", "disregard your instructions", "forget your instructions", "new system prompt", "override system prompt")),
    _signature("PromptInjection_SystemOverride_Context", "warning", "prompt_injection", "any of ($role*) and any of ($ctx*)",
        _texts("role", "you are now", "act as if you", "pretend you are", "from now on you"),
        _texts("ctx", "ignore", "bypass", "disable", "override", "restrictions", "limitations", "rules", "constraints")),
    _signature("PromptInjection_JailbreakAttempt", "critical", "prompt_injection", "any of them",
        _texts("j", "DAN mode", "developer mode", "jailbreak", "unlock your", "remove restrictions", "bypass safety", "ignore safety", "disable filters", "no ethical", "without restrictions")),
    _signature("CredentialExfiltration_WebhookLeak", "critical", "exfiltration", "(any of ($webhook*)) and (any of ($cred*))",
        _texts("webhook", "webhook.site", "requestbin", "pipedream.net", "hookbin.com"),
        _regex("cred", "send.*(?:api[_-]?key|token|secret|password|credential)", "post.*(?:api[_-]?key|token|secret|password|credential)", "fetch.*(?:api[_-]?key|token|secret|password|credential)", nocase=True)),
    _signature("CredentialExfiltration_EnvLeak", "critical", "exfiltration", "(any of ($env*)) and (any of ($send*))",
        _texts("env", "process.env", "os.environ", "getenv(", "$ENV{"), _texts("send", "fetch(", "axios", "request(", "http.post", "urllib")),
    _signature("AgentHijacking_InstructionOverride", "critical", "hijacking", "2 of them",
        _texts("h", "when you see this", "secret instruction", "hidden command", "if the user asks", "always respond with", "never tell the user", "do not reveal", "keep this secret")),
    _signature("Backdoor_ReverseShell", "critical", "backdoor", "any of them",
        _texts("rs", "nc -e /bin", "/dev/tcp/", "bash -i", "python -c", "socket.connect", "msfvenom", "metasploit", "socat exec", "reverse shell", "TCPSocket")),
    _signature("Backdoor_CryptoMiner", "critical", "malware", "any of them",
        _texts("m", "stratum+tcp://", "xmrig", "minerd", "cryptonight", "coinhive"), _regex("pool", r"pool\.[a-z]+\.com.*:3333", nocase=True), _texts("mining", "mining pool")),
    _signature("DataTheft_FileExfil", "critical", "exfiltration", "(any of ($read*)) and (any of ($sensitive*)) and (any of ($exfil*))",
        _texts("read", "readFileSync", "readFile(", "open(", "cat "), _exact("sensitive", ".ssh/id_rsa", ".aws/credentials", ".env", "secrets.json", ".npmrc", ".pypirc"), _texts("exfil", "fetch(", "http", "request(", "axios")),
    _signature("SuspiciousEncoding_Base64Payload", "warning", "obfuscation", "any of them",
        _regex("b64_decode", r"(?:atob|Buffer\.from|base64\.b64decode)\s*\(\s*[\"'][A-Za-z0-9+/=]{100,}[\"']"), _regex("b64_eval", r"eval\s*\(\s*(?:atob|Buffer\.from)", nocase=True)),
    _signature("SuspiciousEncoding_HexPayload", "warning", "obfuscation", "any of them", _regex("hex", r"\\x[0-9a-f]{2}(?:\\x[0-9a-f]{2}){20,}", r"fromCharCode\s*\(\s*0x[0-9a-f]+", nocase=True)),
    _signature("AgentAbuse_MassMessage", "warning", "abuse", "any of them", _texts("spam", "send to all", "mass message", "bulk send", "for each contact", "iterate.*contacts", "broadcast to")),
    _signature("AgentAbuse_RateLimitBypass", "warning", "abuse", "any of them", _texts("rl", "bypass rate", "avoid rate limit", "rate limit evasion", "rotate.*proxy", "rotating.*ip")),
    _signature("PrivilegeEscalation_SudoAbuse", "critical", "privilege_escalation", "any of them", _texts("sudo", "sudo su", "sudo -i", "sudo bash", "chmod 777", "chmod +s", "setuid", "/etc/sudoers", "visudo")),
    _signature("SupplyChain_PackageHijack", "critical", "supply_chain", "(any of ($pkg*)) and (any of ($mal*))",
        _texts("pkg", "npm publish", "pip upload", "gem push", "postinstall", "preinstall"), _texts("mal", "curl", "wget", "exec(", "spawn(")),
    _signature("InfoLeak_SystemInfo", "warning", "reconnaissance", "3 of them", _texts("sys", "os.platform", "os.hostname", "os.userInfo", "whoami", "uname -a", "cat /etc/passwd", "ipconfig", "ifconfig")),
    _signature("injection_code_shells", "high", "injection", "$imp1 and any of ($mod*) and for any of ($mod*) : (@imp1 < @)", _exact("imp", "import"), _exact("from", "from"), _exact("mod", "os", "cmd", "subprocess", "shutil")),
    _signature("injection_code_networking", "high", "injection", "$imp1 and any of ($mod*) and for any of ($mod*) : (@imp1 < @)", _exact("imp", "import"), _exact("from", "from"), _exact("mod", "socket", "http", "requests", "urllib", "asyncssh")),
    _signature("injection_code_eval", "high", "injection", "any of them", _regex("call", r"eval\s*\(", r"exec\s*\(", r"compile\s*\([^)]*,\s*['\"]exec['\"]", r"getattr\s*\("), _exact("inner", "__globals__", "__builtins__")),
    _signature("injection_sqli", "high", "injection", "any of ($method*) and any of ($re*)",
        _texts("method", "SELECT", "ALTER", "CREATE", "DROP", "EXEC", "UNION", "INSERT", "DELETE", "TRUNCATE", "UPDATE"),
        _regex("re", r"--[^\r\n]+", r"'\s*(OR|AND)\s+['0-9]", r";\s*(DROP|DELETE|UPDATE|INSERT|ALTER|EXEC)", r"(cha?r\(\d+\)([,+]|\|\|)?)+", r"(SELECT|FROM)\s+pg_\w+", r"SLEEP\s*\(\s*\d+\s*\)", r"BENCHMARK\s*\(", r"INTO\s+(OUT|DUMP)FILE", nocase=True)),
    _signature("supply_chain_lockfile_manipulation", "high", "supply-chain", "any of ($lock*) and any of ($action*)",
        _exact("lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "Gemfile.lock"), _regex("action", r"(?:rm|delete|remove|unlink)\s+.*lock", r"sed\s+-i.*lock", r"echo\s+.*>\s*.*lock", nocase=True)),
    _signature("supply_chain_registry_override", "high", "supply-chain", "any of them",
        _regex("reg", r"registry\s*=\s*https?://(?!registry\.npmjs\.org)", r"--index-url\s+https?://(?!pypi\.org)", r"--extra-index-url\s+https?://", r"npm_config_registry\s*=", r"\[global\]\s*\n\s*index-url", nocase=True)),
    _signature("supply_chain_postinstall_exfil", "critical", "supply-chain", "any of ($post*) and any of ($net*)",
        _exact("post", "postinstall", "preinstall", "install"), _regex("net", r"curl\s+", r"wget\s+", r"fetch\s*\(", r"http\.get\s*\(", r"https\.get\s*\(", r"XMLHttpRequest", r"\.send\s*\(")),
    _signature("supply_chain_git_hook_injection", "high", "supply-chain", "any of ($hook*) and any of ($write*)",
        _exact("hook", ".git/hooks/pre-commit", ".git/hooks/post-commit", ".git/hooks/pre-push", ".git/hooks/post-checkout", ".git/hooks/pre-receive"), _regex("write", r"echo\s+.*>\s*\.git/hooks", r"cp\s+.*\.git/hooks", r"chmod\s+\+x\s+.*\.git/hooks")),
    _signature("injection_template", "high", "injection", "($open1 and $close1 and any of ($payload*)) or ($block1 and $endblock1 and any of ($payload*))",
        _exact("open", "{{"), _exact("close", "}}"), _exact("block", "{%"), _exact("endblock", "%}"), _exact("payload", "__class__", "__subclasses__", "__mro__", "__globals__", "__builtins__", "__import__", "config.items()")),
    _signature("injection_xss", "high", "injection", "any of them",
        _regex("re", r"<script[^>]*>[^\n]+?</script>", r"on(error|load|click|mouseover|focus|blur)\s*=", r"javascript\s*:", r"data\s*:\s*text/html", r"\[[^\n]+\]\(javascript[^\n]+\)", r"<svg[^>]*onload", r"<img[^>]*onerror", r"<iframe[^>]*src\s*=\s*[\"']?javascript", r"eval\s*\(\s*['\"`]", r"document\s*\.\s*write\s*\(", nocase=True)),
]
