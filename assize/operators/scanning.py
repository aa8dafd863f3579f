"""Code scanners: findings of pattern rules over source files.

Python is parsed with the standard library's ``ast``; other languages are
matched by regular expression, which is an approximation. One pass over the
files, each of which meets only the rules of its language.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = {"error": "high", "warning": "medium", "hint": "low", "info": "low"}

#: Calls on files whose failure is only in their result (fixed values).
_FILE_CALLS = ("create_dir", "create_dir_all", "write", "remove_file", "remove_dir", "remove_dir_all", "rename", "copy", "set_permissions")

#: Pattern rules: id, languages, level (fixed values), what is wrong, expression. Languages share rules where they read alike.
PATTERNS = (
    ("predictable-tmp", "bash", "warning", "temporary file with a guessable name", r'"/tmp/[^"\n]*\$\{?\w+[^"\n]*"'),
    ("toctou-lock-touch", "bash", "warning", "lock is tested and taken in two steps", r"if\s+\[\s+!\s+-f\s+[^\]]+\]\s*;?\s*then\s+touch\s"),
    ("unquoted-variable", "bash", "hint", "variable expanded without quotes", r"(?m)^\s*(?:rm|cp|mv|cd|cat|mkdir)\s+(?:-\w+\s+)*\$\{?\w+"),
    ("unsafe-grep-variable", "bash", "warning", "variable used as a pattern of grep", r"(?m)\bgrep\s+(?!-\w*[FG])(?:-[a-zA-Z]+\s+)*\"?\$\{?\w+"),
    ("iam-wildcard-action", "hcl", "error", "policy grants every action", r"(?m)^\s*(?:Action|actions?)\s*=\s*(?:\"\*\"|\[[^\]]*\"\*\"[^\]]*\])"),
    ("iam-wildcard-resource", "hcl", "warning", "policy covers every resource", r"(?m)^\s*(?:Resource|resources?)\s*=\s*(?:\"\*\"|\[[^\]]*\"\*\"[^\]]*\])"),
    ("bind-all-interfaces", "typescript", "warning", "server listens on all interfaces", r"\.listen\([^)\n]*['\"]0\.0\.0\.0['\"]|\b(?:host|hostname)['\"]?\s*:\s*['\"]0\.0\.0\.0['\"]"),
    ("bind-in-event-listener", "typescript", "warning", "listener bound in place can't be removed", r"\b(?:add|remove)EventListener\([^)\n]*\.bind\("),
    ("console-log-artifact", "typescript", "hint", "debug output left in code", r"\bconsole\.log\("),
    ("block-on-in-async", "rust", "warning", "blocking wait in asynchronous function", r"async\s+(?:unsafe\s+)?fn\s+\w+[^{]*\{[^}]*?\.block_on\("),
    ("builder-unwrap-or-default", "rust", "warning", "failed builder replaced by its default", r"\.build\(\)\s*\.unwrap_or_default\(\)"),
    ("expect-empty-message", "rust", "hint", "expect without a telling message", r"\.expect\(\s*\"(?:[^\"\\]|\\.){0,8}\"\s*,?\s*\)"),
    ("handle-block-on-no-flavor-check", "rust", "warning", "blocking on the current runtime handle", r"\bHandle::current\(\)\s*\.block_on\("),
    ("ignored-io-result", "rust", "warning", "result of file operation discarded", rf"(?:^|(?<=[;{{}}\n]))[ \t]*(?:(?:std::)?fs::(?:{'|'.join(_FILE_CALLS)})|(?:std::fs::)?File::(?:create|open))\([^;\n]*\)\s*;"),
    ("silent-error-conversion", "rust", "hint", "error turned into nothing", r"(?:fs::(?:read_to_string|read|read_dir|metadata)|serde_json::from_str|env::var|\.parse(?:::<\w+>)?|::from_str)\([^;\n]*\)\s*\.(?:ok|unwrap_or_default)\(\)"),
    ("string-byte-slice", "rust", "hint", "text sliced by byte index", r"&\w+\[(?:\.\.\d+|\d+\.\.\d*)\]"),
    ("as-any-cast", "typescript", "hint", "cast to any", r"\bas\s+any\b"),
    ("bare-catch", "typescript", "warning", "empty catch block", r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*(?:(?://[^\n]*|/\*.*?\*/)\s*)*\}"),
    ("cors-wildcard-origin", "typescript", "warning", "any origin is allowed", r"\.(?:setHeader|header|set)\(\s*['\"](?i:access-control-allow-origin)['\"]\s*,\s*['\"]\*['\"]"),
    ("eval-non-literal", "typescript", "error", "code run from a value", r"\b(?:eval|new\s+Function|Function)\(\s*(?![\"'`)])[A-Za-z_$(]"),
    ("json-parse-as-type", "typescript", "warning", "parsed JSON asserted to be of a type", r"JSON\.parse\([^;\n]*\)\s+as\s+(?!unknown\b)\w+"),
    ("non-literal-regexp", "typescript", "warning", "pattern built from a value", r"new\s+RegExp\(\s*(?![\"'`/)])[A-Za-z_$]"),
    ("non-null-assertion", "typescript", "hint", "absence of null asserted", r"[\w\])]!(?=[.;,)\[])"),
    ("nullish-coalescing-preferred", "typescript", "hint", "|| replaces 0 and empty text as well", r"\|\|\s*(?:0|\"\"|''|false|\[\]|\{\})(?=\s*[;,)\n])"),
    ("path-traversal-join", "typescript", "warning", "path joined with request data", r"path\.(?:join|resolve)\([^)\n]*\breq\.(?:params|query|body)"),
    ("promise-async-executor", "typescript", "warning", "asynchronous promise executor", r"new\s+Promise(?:<[^>]*>)?\(\s*async\b"),
    ("sql-template-injection", "typescript", "error", "statement built from a template", r"`\s*(?i:select|insert|update|delete)\b[^`]*\$\{"),
    ("sync-in-async", "typescript", "warning", "synchronous file access in asynchronous function", r"async\s+(?:function\b[^{]*|\([^)]*\)\s*=>\s*)\{[^}]*?\b\w+Sync\("),
    ("tautological-length", "typescript", "warning", "length is never negative", r"\.length\s*>=\s*0(?!\d)"),
    ("tls-reject-unauthorized-false", "typescript", "error", "certificates aren't checked", r"\brejectUnauthorized\s*:\s*false\b"),
    ("unsafe-url-concat", "typescript", "hint", "address built by concatenation", r"\b\w*[uU]rl\s*\+\s*[\"'`]/|[\"'`]https?://[^\"'`\n]*[\"'`]\s*\+\s*\w"),
    ("float-zero-fallback", "yaml", "warning", "missing value read as zero", r"\|\s*float\(\s*0(?:\.0)?\s*\)"),
    ("ha-jinja-loop-scoped-reassignment", "yaml", "warning", "value set in a loop is lost after it", r"\{%-?\s*for\b(?:(?!endfor|namespace\().)*?\{%-?\s*set\s+\w+\s*=(?:(?!endfor|namespace\().)*?endfor"),
    ("ha-template-none-fallback", "yaml", "warning", "template without default before a unit", r"\{\{(?:(?!default|\}\}).)*states\((?:(?!default|\}\}).)*\}\}\s*(?:%|°|kWh|[WVA]\b)"),
)

#: Scanner findings: title, languages, severity, category (fixed values), expression; ``{}`` takes the first group.
INLINE = (
    ("Use of `unsafe` block", "rust", "info", "security", r"\bunsafe\s*\{"),
    ("Use of `.unwrap()` may panic at runtime", "rust", "low", "security", r"\.unwrap\(\)"),
    ("ESPHome OTA section has no password -- firmware updates are unprotected", "yaml", "medium", "security", r"(?m)^ota:[ \t]*\n(?!(?:[ \t]+[^\n]*\n)*?[ \t]+password:)"),
    ("ESPHome API has no encryption configured", "yaml", "medium", "security", r"(?m)^api:[ \t]*\n(?!(?:[ \t]+[^\n]*\n)*?[ \t]+encryption:)"),
    ("Hardcoded secret in `{}`", "yaml", "high", "security", r"(?mi)^[ \t-]*(\w*(?:password|secret|token|api_key)):[ \t]+(?!!secret|\$|\{|\"?\s*$)[\"']?[^\s\"'#]{6,}"),
    ("Server binding to 0.0.0.0 exposes all interfaces", "yaml", "medium", "security", r"(?mi)^[ \t-]*(?:host|bind|server_host|listen)\w*:[ \t]*[\"']?0\.0\.0\.0"),
    ("URL contains embedded credentials", "yaml", "high", "security", r"://[^\s:/@{$]+:[^\s@{$]+@"),
    ("Template uses `states()` without availability check", "yaml", "info", "quality", r"\{\{(?:(?!has_value|is_number|default|\}\}).)*\bstates\((?:(?!has_value|is_number|default|\}\}).)*\}\}"),
    ("Deprecated dot-notation state access", "yaml", "medium", "quality", r"\bstates\.\w+\.\w+\.state\b"),
    ("entity_id without domain prefix", "yaml", "high", "bug", r"(?m)^[ \t-]*entity_id:[ \t]*[a-z0-9_]+[ \t]*$"),
    ("service without domain prefix", "yaml", "medium", "bug", r"(?m)^[ \t-]*(?:service|action):[ \t]*[a-z0-9_]+[ \t]*$"),
    ("Use of `eval()` is a code injection risk", "typescript", "critical", "security", r"\beval\("),
    ("Use of `document.write()` is an XSS risk", "typescript", "critical", "security", r"\bdocument\.write(?:ln)?\("),
    ("`{}` debug artifact left in code", "typescript", "info", "quality", r"\b(console\.(?:log|debug)|debugger)\b"),
    ("Hardcoded secret in `{}`", "typescript", "high", "security", r"(?i)\b(\w*(?:password|secret|token|api_?key))\s*[:=]\s*[\"'`](?!\$\{)[^\"'`\s]{6,}[\"'`]"),
    ("Direct `{}` assignment is an XSS risk", "typescript", "high", "security", r"\.(innerHTML|outerHTML)\s*=(?!=)"),
    ("Use of `any` type defeats TypeScript's type safety", "typescript", "info", "quality", r":\s*any\b"),
    ("Empty `catch` block silently swallows errors", "typescript", "medium", "reliability", r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}"),
    ("`{}` blocks the event loop in async function", "typescript", "medium", "concurrency", r"async\b[^{]*\{[^}]*?\b(\w+Sync)\("),
    ("`.length >= 0` is always true", "typescript", "medium", "correctness", r"\.length\s*>=\s*0(?!\d)"),
    ("Use of non-null assertion operator `!` bypasses TypeScript's type safety", "typescript", "info", "quality", r"[\w\])]!(?=[.;,)\[])"),
    ("Use of `eval` is a code injection risk", "bash", "high", "security", r"(?m)^\s*eval\s"),
    ("`chmod 777` grants world-writable permissions", "bash", "medium", "security", r"\bchmod\s+(?:-R\s+)?0?777\b"),
    ("Piping curl/wget to shell executes untrusted remote code", "bash", "critical", "security", r"\b(?:curl|wget)\b[^\n|]*\|\s*(?:sudo\s+)?(?:ba|z)?sh\b"),
    ("Hardcoded secret in shell variable `{}`", "bash", "high", "security", r"(?mi)^\s*(?:export\s+)?(\w*(?:password|secret|token|api_key))=[\"']?(?!\$)[^\s\"'$]{6,}"),
    ("Use COPY instead of ADD for local files", "dockerfile", "medium", "quality", r"(?mi)^ADD\s+(?!https?://|\S+\.(?:tar|tgz|gz|xz|bz2))"),
    ("Secret hardcoded in Dockerfile ENV/ARG", "dockerfile", "high", "security", r"(?mi)^(?:ENV|ARG)\s+\w*(?:PASSWORD|SECRET|TOKEN|API_KEY)\w*[= ]+(?!\$)\S{6,}"),
    ("RUN pipes curl/wget to shell -- executes untrusted remote code", "dockerfile", "critical", "security", r"(?mi)^RUN\b[^\n]*\b(?:curl|wget)\b[^\n|]*\|\s*(?:ba)?sh\b"),
    ("FROM uses `latest` or untagged image -- builds are not reproducible", "dockerfile", "medium", "reliability", r"(?mi)^FROM\s+(?!scratch\b)(?:--\S+\s+)?(?:[^\s:@]+(?::latest)?)(?:\s+AS\s+\S+)?\s*$"),
    ("Hardcoded secret in `{}`", "hcl", "high", "security", r"(?mi)^\s*(\w*(?:password|secret|token|api_key))\s*=\s*\"(?!\$\{)[^\"\s]{6,}\""),
    ("Wildcard IAM action grants unrestricted permissions", "hcl", "high", "security", r"(?mi)\bactions?\"?\s*[=:]\s*\[?\s*\"\*\""),
    ("Security group open to 0.0.0.0/0 on sensitive port", "hcl", "high", "security", r"(?s)ingress\s*\{(?:(?!\}).)*?from_port\s*=\s*(?:22|3389|3306|5432|6379|27017)\b(?:(?!\}).)*?0\.0\.0\.0/0"),
    ("Missing required_version in terraform block", "hcl", "medium", "reliability", r"(?ms)^terraform\s*\{(?!(?:(?!^\}).)*required_version)"),
    ("Provider `{}` in required_providers has no version constraint", "hcl", "medium", "reliability", r"(?s)required_providers\s*\{[^}]*?(\w+)\s*=\s*\{(?:(?!version|\}).)*\}"),
)

SCHEMA = "path string, rule string, title string, severity string, category string, line_start int, line_end int"
MUTATORS = ("append", "remove", "pop", "extend", "insert", "add", "discard", "clear")
HTTP = r"requests\.(?:get|post|put|delete|patch|head|options|request)"
SECRET_NAME = re.compile(r"(?i)(?:password|passwd|secret|token|api_?key)$")


class _Python(ast.NodeVisitor):
    """Findings of one Python file, by one walk that knows what it is inside of."""

    def __init__(self, text: str, complex_from: int):
        self.found: list[tuple] = []
        self.complex_from, self.text = complex_from, text
        self.is_async, self.loops, self.withs = [False], [], 0
        self.routes = [False]

    def rule(self, node: ast.AST, rule: str, level: str, message: str) -> None:
        self.found.append((rule, f"{rule}: {message}", LEVEL[level], "ast-pattern", node.lineno, node.end_lineno))

    def inline(self, node: ast.AST, title: str, severity: str, category: str) -> None:
        self.found.append(("inline", title, severity, category, node.lineno, node.end_lineno))

    def _function(self, node) -> None:
        score = complexity(node)
        if score >= self.complex_from:
            self.inline(node, f"Function `{node.name}` has cyclomatic complexity {score}", "medium" if score >= 2 * self.complex_from else "low", "complexity")
        route = any(re.search(r"\.(?:get|post|put|delete|patch)\b", ast.unparse(d)) for d in node.decorator_list)
        args = node.args.posonlyargs + node.args.args
        for arg, default in zip(args, [None] * (len(args) - len(node.args.defaults)) + node.args.defaults):
            if isinstance(default, (ast.List, ast.Dict, ast.Set)):
                self.inline(default, f"Mutable default argument `{arg.arg}`", "medium", "bug")
            page = arg.arg in ("limit", "offset", "page", "size", "page_size", "per_page") and arg.annotation is not None and ast.unparse(arg.annotation) in ("int", "Optional[int]")
            if route and page and "Query(" not in (ast.unparse(default) if default else ""):
                self.rule(arg, "fastapi-unbounded-pagination", "warning", "page size without a bound")
        self.is_async.append(isinstance(node, ast.AsyncFunctionDef))
        loops, self.loops = self.loops, []
        self.generic_visit(node)
        self.loops = loops
        self.is_async.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _loop(self, node) -> None:
        self.loops.append(ast.unparse(node.iter) if isinstance(node, (ast.For, ast.AsyncFor)) else "")
        self.generic_visit(node)
        self.loops.pop()

    visit_For = visit_AsyncFor = visit_While = visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _loop

    def _with(self, node) -> None:
        self.withs += 1
        for item in node.items:
            self.visit(item)
        self.withs -= 1
        for x in node.body:
            self.visit(x)

    visit_With = visit_AsyncWith = _with

    def visit_Assert(self, node: ast.Assert) -> None:
        self.rule(node, "assert-in-prod-code", "hint", "assertion is left out under -O")
        self.generic_visit(node)

    def visit_If(self, node: ast.If) -> None:
        if ast.unparse(node.test) == "cls._instance is None" and any(isinstance(x, ast.Assign) and ast.unparse(x.targets[0]) == "cls._instance" for x in node.body):
            self.rule(node, "non-threadsafe-singleton", "warning", "instance is made without a lock")
        self.generic_visit(node)

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        kind = ast.unparse(node.type) if node.type else ""
        only_pass = all(isinstance(x, ast.Pass) for x in node.body)
        if only_pass and kind in ("", "Exception", "BaseException"):
            self.inline(node, "Catch-all `except: pass` silently swallows errors", "medium", "reliability")
        if only_pass and not kind:
            self.rule(node, "bare-except-pass", "warning", "all errors are swallowed")
        body = "\n".join(ast.unparse(x) for x in node.body)
        if kind == "Exception" and re.search(r"\b(?:pass|continue|return)\b", body) and not re.search(r"\braise\b|\w*(?:log|print|warn)\w*[.(]", body):
            self.rule(node, "broad-exception-catch", "hint", "every exception is caught")
        if node.name and re.search(rf"(?:return|Response|jsonify|detail)\b[^\n]*\bstr\({node.name}\)", body):
            self.inline(node, "Exception details disclosed in API response", "medium", "security")
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        name = ast.unparse(node.targets[0])
        if isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) and len(node.value.value) >= 6 and SECRET_NAME.search(name):
            self.inline(node, f"Hardcoded secret in `{name}`", "high", "security")
        if isinstance(node.value, ast.Call) and ast.unparse(node.value.func) == "open" and not self.withs:
            self.rule(node, "resource-no-context-manager", "hint", "file is opened outside a with statement")
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        name = ast.unparse(node.func)
        named = {k.arg: ast.unparse(k.value) for k in node.keywords if k.arg}
        first = node.args[0] if node.args else None
        values = [*map(ast.unparse, node.args), *named.values()]
        any_host = any(v.strip("'\"") == "0.0.0.0" for v in values)
        if name in ("eval", "exec"):
            self.inline(node, f"Use of `{name}()` is a code injection risk", "critical", "security")
            if first is not None and not isinstance(first, ast.Constant):
                self.rule(node, "eval-exec-non-literal", "error", "code run from a value")
        if named.get("debug") == "True":
            if name.endswith(".run"):
                self.inline(node, "Server running with debug=True", "high", "security")
            if name.endswith(".run") or name == "Flask":
                self.rule(node, "flask-debug-true", "error", "debugger is reachable")
        if any_host and re.search(r"\.run$|\.bind$|^serve", name):
            self.inline(node, "Server binding to 0.0.0.0 exposes all network interfaces", "medium", "security")
        if any_host and re.fullmatch(r"(?:app|application|server|uvicorn)\.run|socket\.bind", name):
            self.rule(node, "bind-all-interfaces", "warning", "server listens on all interfaces")
        if name.endswith("execute") and first is not None:
            if isinstance(first, ast.JoinedStr):
                self.inline(node, "Potential SQL injection via f-string in execute()", "critical", "security")
            if isinstance(first, ast.Call) and ast.unparse(first.func).endswith(".format"):
                self.inline(node, "Potential SQL injection via .format() in execute()", "critical", "security")
            inner = first.args[0] if isinstance(first, ast.Call) and ast.unparse(first.func) == "text" and first.args else first
            if isinstance(node.func, ast.Attribute) and (isinstance(inner, ast.JoinedStr) or isinstance(inner, ast.BinOp)):
                self.rule(node, "sqlalchemy-raw-query", "error", "statement built from values")
        if name == "open" and "encoding" not in named and not re.search(r"b", named.get("mode", "") + (ast.unparse(node.args[1]) if len(node.args) > 1 else "")):
            self.inline(node, "`open()` without explicit `encoding` parameter", "low", "reliability")
            self.rule(node, "open-no-encoding", "hint", "encoding depends on the system")
        if self.is_async[-1]:
            if name.endswith(".result") and not node.args:
                self.inline(node, "Blocking `.result()` call in async function", "high", "concurrency")
            if re.fullmatch(rf"time\.sleep|{HTTP}|urllib\.request\.urlopen|subprocess\.(?:run|call|check_call|check_output|Popen)|os\.system", name):
                self.rule(node, "blocking-call-in-async", "warning", "event loop waits for a blocking call")
        if name == "os.chmod" and any(v in ("511", "438") for v in values):
            self.rule(node, "insecure-file-permissions", "warning", "file is open to everyone")
        if name == "hashlib.md5":
            self.rule(node, "md5-usage", "warning", "digest is broken")
        if "." in name and name.rsplit(".", 1)[1] in MUTATORS and name.rsplit(".", 1)[0] in self.loops:
            self.inline(node, f"Mutating `{name.rsplit('.', 1)[0]}` while iterating over it", "high", "bug")
            self.rule(node, "mutation-during-iteration", "warning", "collection changes while it is walked")
        if name == "any" and isinstance(first, ast.GeneratorExp) and isinstance(first.elt, ast.Compare) and [type(o) for o in first.elt.ops] == [ast.In] and len(first.generators) == 1 and not first.generators[0].ifs and ast.dump(first.elt.left) == ast.dump(first.generators[0].target).replace("Store()", "Load()"):
            self.rule(node, "naive-url-blacklist", "warning", "address checked as text")
        if self.loops and re.fullmatch(r"re\.(?:sub|match|search|findall|finditer|fullmatch|split|subn)", name):
            self.rule(node, "re-compile-in-loop", "hint", "pattern is compiled again and again")
        if re.fullmatch(HTTP, name) and named.get("verify") == "False":
            self.rule(node, "requests-verify-false", "warning", "certificates aren't checked")
        if name == "subprocess.run" and "check" not in named:
            self.rule(node, "subprocess-no-check", "hint", "exit code is ignored")
        if re.fullmatch(r"subprocess\.(?:run|call|check_output|check_call|Popen)", name) and named.get("shell") == "True":
            self.rule(node, "subprocess-shell-true", "warning", "command goes through a shell")
        if name in ("urlopen", "urllib.request.urlopen") and not self.withs:
            self.rule(node, "urlopen-no-context-manager", "hint", "response isn't closed")
        self.generic_visit(node)


_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)


def complexity(function: ast.AST) -> int:
    """1 + decisions of a function, those of inner functions included."""
    score = 1
    for x in ast.walk(function):
        score += isinstance(x, _DECISIONS) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
    return score


_COMPILED = [(*r[:4], re.compile(r[4], re.S)) for r in PATTERNS]
_INLINE = [(*r[:4], re.compile(r[4])) for r in INLINE]


_TEST_ITEM = re.compile(r"#\[(?:cfg\(test\)|test)\](?:\s*#\[[^\]\n]*\])*\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:mod|fn)\b[^{;]*\{")


def _rust_tests(text: str) -> list[tuple[int, int]]:
    """Places of test modules and test functions: from the attribute to the brace that closes the item."""
    out: list[tuple[int, int]] = []
    for m in _TEST_ITEM.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        depth, at = 1, m.end()
        while depth and (b := _BRACE.search(text, at)):
            depth += 1 if b.group() == "{" else -1
            at = b.end()
        out.append((m.start(), at if not depth else len(text)))
    return out


_BRACE = re.compile(r"[{}]")


def _structure(lang: str, text: str) -> Iterator[tuple]:
    """Findings about a file as a whole."""
    lines = text.split("\n")
    if lang == "bash":
        if not lines[0].startswith("#!"):
            yield ("inline", "Script has no shebang line", "low", "quality", 1, 1)
        if not re.search(r"(?m)^\s*set\s+-\w*e|^#!.*\s-\w*e", text):
            yield ("inline", "Script has no `set -e` -- errors will be silently ignored", "medium", "reliability", 1, 1)
    if lang == "dockerfile":
        for word, title, severity, category in (("USER", "No USER instruction -- container runs as root", "medium", "security"), ("HEALTHCHECK", "No HEALTHCHECK instruction", "low", "reliability")):
            if not re.search(rf"(?mi)^{word}\b", text):
                yield ("inline", title, severity, category, 1, len(lines))
        for word in ("CMD", "ENTRYPOINT"):
            at = [n for n, x in enumerate(lines, 1) if re.match(rf"(?i){word}\b", x)]
            if len(at) > 1:
                yield ("inline", f"Multiple {word} instructions -- only the last one takes effect", "medium", "bug", at[0], at[-1])
    if lang == "yaml":
        seen: dict[tuple, int] = {}
        stack: list[tuple[int, int]] = []
        for n, x in enumerate(lines, 1):
            m = re.match(r"( *)(- )?([A-Za-z_][\w\-]*):(?:\s|$)", x)
            if not m:
                continue
            depth = len(m[1]) + (2 if m[2] else 0)
            stack = [s for s in stack if s[0] < depth or (s[0] == depth and not m[2])]
            if not any(s[0] == depth for s in stack):
                stack.append((depth, n))
            scope = (*[s for s in stack if s[0] <= depth], m[3])
            if scope in seen:
                yield ("inline", f"Duplicate key `{m[3]}` in mapping", "high", "bug", n, n)
            seen[scope] = n
        for m in re.finditer(r"(?m)^- (?:alias|id|trigger|description):(?:.*\n(?:[ \t]+.*\n?|\n)*)", text):
            block, line = m.group(), text.count("\n", 0, m.start()) + 1
            if not re.search(r"(?m)^(?:- |  )triggers?:", block):
                continue
            end = line + block.rstrip("\n").count("\n")
            if not re.search(r"(?m)^(?:- |  )id:", block):
                yield ("inline", "Automation missing `id` -- UI management and debug traces are disabled", "medium", "quality", line, end)
            if not re.search(r"(?m)^(?:- |  )mode:", block):
                yield ("inline", "Automation has no explicit `mode` (defaults to `single`)", "info", "quality", line, end)
            for old in ("trigger", "condition", "action"):
                if re.search(rf"(?m)^(?:- |  ){old}:", block):
                    yield ("inline", f"Deprecated singular `{old}:` -- use `{old}s:` instead", "medium", "quality", line, end)
            for k in re.findall(r"(?m)^(?:- |  )((?:trigger|condition|action)s?):[ \t]*(?:\[\])?[ \t]*$(?!\n[ \t]+-|\n    )", block):
                yield ("inline", f"Empty `{k}:` in automation", "high", "bug", line, end)
        if re.search(r"(?m)^services:\s*$", text):
            for m in re.finditer(r"(?m)^  ([\w\-]+):[ \t]*\n((?:    .*\n?|\n)+)", text[text.index("services:") :] + "\n"):
                line = text.count("\n", 0, text.index("services:") + m.start()) + 1
                if "no-new-privileges" not in m[2]:
                    yield ("inline", f"Docker Compose service `{m[1]}` missing `no-new-privileges` security option", "medium", "security", line, line)
                if "read_only: true" not in m[2]:
                    yield ("inline", f"Docker Compose service `{m[1]}` has writable root filesystem", "low", "security", line, line)


def scan_text(lang: str, text: str, complex_from: int = 10) -> list[tuple]:
    """``(rule, title, severity, category, first line, last line)`` of every finding, in order of lines."""
    found: list[tuple] = []
    if lang == "python":
        try:
            walker = _Python(text, complex_from)
            walker.visit(ast.parse(text))
            found += walker.found
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(ends, at) + 1
    for rule, langs, level, message, rx in _COMPILED:
        if lang == langs:
            found += [(rule, f"{rule}: {message}", LEVEL[level], "ast-pattern", line(m.start()), line(m.end())) for m in rx.finditer(text)]
    tests = _rust_tests(text) if lang == "rust" else []
    for title, langs, severity, category, rx in _INLINE:
        if lang == langs:
            found += [("inline", title.replace("{}", m[1]) if "{}" in title else title, severity, category, line(m.start()), line(m.end())) for m in rx.finditer(text) if not (".unwrap()" in title and any(a <= m.start() < b for a, b in tests))]
    found += _structure(lang, text)
    return sorted(set(found), key=lambda x: (x[4], x[0], x[1]))


def scan(files: DataFrame, complex_from: int = 10) -> DataFrame:
    """Findings of files (``path, lang, text``): ``path, rule, title, severity, category, line_start, line_end``.

    Null texts and unknown languages have none; Python that can't be parsed has none either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *x) for p, lang, t in zip(*(batch[c].to_pylist() for c in ("path", "lang", "text"))) if t for x in scan_text(lang or "", t, complex_from)]
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.string(),) * 5 + (pa.int32(),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "rule", "title", "severity", "category", "line_start", "line_end"])

    known = F.col("lang").isin("python", "rust", "typescript", "bash", "dockerfile", "hcl", "yaml")
    return files.select("path", "lang", "text").filter(F.col("text").isNotNull() & known).mapInArrow(run, SCHEMA)


#: Language by file ending (fixed values).
ENDINGS = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "go": "go", "sh": "bash", "bash": "bash",
    "tf": "hcl", "hcl": "hcl", "tfvars": "hcl", "yaml": "yaml", "yml": "yaml", "md": "markdown",
}


def language(path):
    """Language column of a path column."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), ending)
    return F.when(F.lower(path).rlike(r"(^|/)dockerfile[^/]*$"), "dockerfile").otherwise(name)
