"""Extraction of definitions, imports, calls, routes, exports and typeof sites from source texts.

Python is read with its own parser. For the other languages a scanner blanks comments and strings (keeping positions) and
patterns find declarations; their blocks end at the matching brace. A file that cannot be read gives null and the run goes
on. One Arrow batch of files at a time; nothing is shared between files, so a lost task repeats alone.
"""

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.files import language

VERBS = ["get", "post", "put", "delete", "patch"]
# Callees that send requests, with their methods (``*``: any).
CLIENTS = {"fetch": "GET", "axios": "GET", "http.request": "*", "https.request": "*", "http.get": "GET", "https.get": "GET", "http.Get": "GET", "http.Post": "POST", "http.NewRequest": "*"}
CLIENTS |= {f"{lib}.{v}": v.upper() for lib in ("axios", "requests", "httpx") for v in VERBS}
TEST_LEAVES = ["it", "test", "specify", "it.only", "it.skip", "it.each", "test.only", "test.skip", "test.each", "fit", "xit", "xtest"]
TEST_GROUPS = ["describe", "context", "suite", "describe.only", "describe.skip", "describe.each", "fdescribe", "xdescribe", "suite.only", "suite.skip"]
# Receivers of route declarations.
ROUTERS = ["app", "router", "server", "api", "fastify", "r", "e", "mux"]
TYPEOF = [
    ("Awaited<ReturnType<typeof>>", re.compile(r"\bAwaited\s*<\s*ReturnType\s*<\s*typeof\s+([\w$]+)")),
    ("ReturnType<typeof>", re.compile(r"\bReturnType\s*<\s*typeof\s+([\w$]+)")),
    ("Parameters<typeof>", re.compile(r"\bParameters\s*<\s*typeof\s+([\w$]+)")),
    ("InstanceType<typeof>", re.compile(r"\bInstanceType\s*<\s*typeof\s+([\w$]+)")),
    ("keyof typeof", re.compile(r"\bkeyof\s+typeof\s+([\w$]+)")),
    ("typeof", re.compile(r"\btypeof\s+([\w$]+)")),
]

DEFINITION = (
    "name:string,kind:string,signature:string,return_type:string,start_line:int,end_line:int,is_exported:boolean,is_default:boolean,is_async:boolean,is_static:boolean,is_abstract:boolean,"
    "decorators:array<string>,receiver:string,implements:array<string>,extends_clause:string"
)
SCHEMA = (
    f"path string, language string, line_count int, definitions array<struct<{DEFINITION}>>, "
    "imports array<struct<source:string,name:string,original:string,is_type_only:boolean>>, "
    "calls array<struct<callee:string,receiver:string,line:int,is_async:boolean,is_new:boolean,args:int,url:string,http_method:string>>, "
    "routes array<struct<method:string,route_path:string,handler:string,line:int>>, "
    "typeof_sites array<struct<symbol:string,pattern:string,line:int,context:string>>, exports array<string>, has_error boolean, first_error_line int"
)


def _definition(name, kind, start, end, **more) -> dict:
    base = dict(signature=None, return_type=None, is_exported=True, is_default=False, is_async=False, is_static=False, is_abstract=False, decorators=[], receiver=None, implements=[], extends_clause=None)
    return {"name": name, "kind": kind, **base, "start_line": start, "end_line": end, **more}


def _request(full: str, args: list, options_method: str | None) -> tuple[str | None, str | None]:
    if full not in CLIENTS:
        return None, None
    return (args[0] if args else None), options_method or CLIENTS[full]


class _Python(ast.NodeVisitor):
    def __init__(self):
        self.definitions, self.imports, self.calls, self.routes, self.awaited = [], [], [], [], set()
        self.scope = []

    def _function(self, node, is_async=False):
        own = bool(self.scope) and self.scope[-1][0] == "class"
        marks = [ast.unparse(d).split("(")[0] for d in node.decorator_list]
        text = f"{node.name}({ast.unparse(node.args)})"
        self.definitions.append(_definition(
            node.name, "Method" if own else "Function", node.lineno, node.end_lineno, signature=text[:200], return_type=ast.unparse(node.returns) if node.returns else None, is_async=is_async,
            is_exported=not node.name.startswith("_"), is_static="staticmethod" in marks, is_abstract=any(m.endswith("abstractmethod") for m in marks), decorators=marks, receiver=self.scope[-1][1] if own else None,
        ))
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                if d.func.attr in VERBS or d.func.attr == "route":
                    self.routes.append({"method": "*" if d.func.attr == "route" else d.func.attr.upper(), "route_path": d.args[0].value, "handler": node.name, "line": d.lineno})
        self.scope.append(("function", node.name))
        self.generic_visit(node)
        self.scope.pop()

    def visit_FunctionDef(self, node):
        self._function(node)

    def visit_AsyncFunctionDef(self, node):
        self._function(node, True)

    def visit_ClassDef(self, node):
        bases = [ast.unparse(b) for b in node.bases]
        self.definitions.append(_definition(node.name, "Class", node.lineno, node.end_lineno, is_exported=not node.name.startswith("_"), decorators=[ast.unparse(d).split("(")[0] for d in node.decorator_list], extends_clause=bases[0] if bases else None))
        self.scope.append(("class", node.name))
        self.generic_visit(node)
        self.scope.pop()

    def visit_Import(self, node):
        self.imports += [{"source": a.name, "name": a.asname or a.name, "original": None, "is_type_only": False} for a in node.names]

    def visit_ImportFrom(self, node):
        source = "." * node.level + (node.module or "")
        self.imports += [{"source": source, "name": a.asname or a.name, "original": a.name if a.asname else None, "is_type_only": False} for a in node.names]

    def visit_Await(self, node):
        if isinstance(node.value, ast.Call):
            self.awaited.add(id(node.value))
        self.generic_visit(node)

    def visit_Call(self, node):
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name:
            receiver = ast.unparse(f.value) if isinstance(f, ast.Attribute) else None
            texts = [a.value for a in node.args if isinstance(a, ast.Constant) and isinstance(a.value, str)][:1]
            url, method = _request(f"{receiver}.{name}" if receiver else name, texts, None)
            self.calls.append({"callee": name, "receiver": receiver, "line": node.lineno, "is_async": id(node) in self.awaited, "is_new": False, "args": len(node.args) + len(node.keywords), "url": url, "http_method": method})
        self.generic_visit(node)


def python_file(text: str) -> dict:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return {"definitions": [], "imports": [], "calls": [], "routes": [], "exports": [], "has_error": True, "first_error_line": getattr(e, "lineno", None)}
    v = _Python()
    v.visit(tree)
    exports = [n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and not n.name.startswith("_")]
    return {"definitions": v.definitions, "imports": v.imports, "calls": v.calls, "routes": v.routes, "exports": exports, "has_error": False, "first_error_line": None}


_SKIP = re.compile(r"""//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`""", re.S)
_HASH_SKIP = re.compile(r"""\#[^\n]*|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*\"""", re.S)


def blanked(text: str, hashes: bool = False) -> str:
    """The text with comments and strings blanked, line ends and positions kept."""
    return (_HASH_SKIP if hashes else _SKIP).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _block_end(code: str, at: int) -> int:
    """Position after the block that opens first after ``at``; the line's end where none opens before a ``;``."""
    open_ = code.find("{", at)
    stop = code.find(";", at)
    if open_ < 0 or 0 <= stop < open_:
        return stop if stop >= 0 else len(code)
    depth = 0
    for m in re.finditer(r"[{}]", code[open_:]):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return open_ + m.end()
    return len(code)


_JS = [
    ("Class", re.compile(r"(?m)^(?P<lead>[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?)class\s+(?P<name>[\w$]+)(?:\s*<[^{]*?>)?(?:\s+extends\s+(?P<base>[\w$.]+)[^{]*?)?(?:\s+implements\s+(?P<impl>[^{]+))?\s*(?=\{)")),
    ("Interface", re.compile(r"(?m)^(?P<lead>[ \t]*(?:export\s+)?(?:default\s+)?)interface\s+(?P<name>[\w$]+)(?:\s+extends\s+(?P<base>[\w$.]+))?")),
    ("Enum", re.compile(r"(?m)^(?P<lead>[ \t]*(?:export\s+)?(?:const\s+)?)enum\s+(?P<name>[\w$]+)")),
    ("Type", re.compile(r"(?m)^(?P<lead>[ \t]*(?:export\s+)?)type\s+(?P<name>[\w$]+)\s*(?:<[^=]*>)?\s*=")),
    ("Function", re.compile(r"(?m)^(?P<lead>[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?)function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^(]*>)?(?P<args>\([^)]*\))(?:\s*:\s*(?P<ret>[^{;]+))?")),
    ("Function", re.compile(r"(?m)^(?P<lead>(?:export\s+)?)(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?P<mod>async\s+)?(?:function\b|(?P<args>\([^)]*\)|[\w$]+)(?:\s*:\s*(?P<ret>[^=]+?))?\s*=>)")),
    ("Method", re.compile(r"(?m)^[ \t]+(?P<lead>(?:(?:public|private|protected|static|async|abstract|override|readonly)\s+)*)(?P<name>[\w$]+)\s*(?:<[^(]*>)?(?P<args>\([^)]*\))(?:\s*:\s*(?P<ret>[^{;]+))?\s*\{")),
]
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "constructor_", "with"}
_OTHER = {
    "go": [("Function", r"(?m)^func\s+(?P<name>\w+)\s*\("), ("Method", r"(?m)^func\s+\((?:\w+\s+)?\*?(?P<recv>\w+)\)\s*(?P<name>\w+)\s*\("), ("Class", r"(?m)^type\s+(?P<name>\w+)\s+struct"), ("Interface", r"(?m)^type\s+(?P<name>\w+)\s+interface")],
    "rust": [("Function", r"(?m)^[ \t]*(?P<lead>pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(?P<name>\w+)"), ("Class", r"(?m)^[ \t]*(?P<lead>pub\s+)?struct\s+(?P<name>\w+)"), ("Interface", r"(?m)^[ \t]*(?P<lead>pub\s+)?trait\s+(?P<name>\w+)"), ("Enum", r"(?m)^[ \t]*(?P<lead>pub\s+)?enum\s+(?P<name>\w+)")],
    "java": [("Class", r"(?m)^[ \t]*(?P<lead>(?:(?:public|private|protected|static|final|abstract|sealed|internal|partial)\s+)*)class\s+(?P<name>\w+)(?:\s*(?:extends|:)\s*(?P<base>\w+))?(?:\s+implements\s+(?P<impl>[^{]+))?"), ("Interface", r"(?m)^[ \t]*(?P<lead>(?:public|private|internal)\s+)?interface\s+(?P<name>\w+)"), ("Enum", r"(?m)^[ \t]*(?P<lead>(?:public|private|internal)\s+)?enum\s+(?P<name>\w+)"), ("Method", r"(?m)^[ \t]+(?P<lead>(?:(?:public|private|protected|static|final|abstract|async|override|virtual)\s+)+)[\w<>\[\],. ?]+\s+(?P<name>\w+)\s*\([^)]*\)\s*(?:throws [\w, ]+)?\{")],
    "c": [("Function", r"(?m)^[A-Za-z_][\w \t*:<>,&]*?[\s*&](?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?\{"), ("Class", r"(?m)^(?:typedef\s+)?(?:struct|class)\s+(?P<name>\w+)[^;{]*(?=\{)"), ("Enum", r"(?m)^(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>\w+)")],
    "ruby": [("Class", r"(?m)^(?P<ind>[ \t]*)class\s+(?P<name>[\w:]+)(?:\s*<\s*(?P<base>[\w:]+))?"), ("Function", r"(?m)^(?P<ind>[ \t]*)def\s+(?:self\.)?(?P<name>\w+[?!]?)")],
    "php": [("Class", r"(?m)^[ \t]*(?:abstract\s+|final\s+)?class\s+(?P<name>\w+)(?:\s+extends\s+(?P<base>\w+))?(?:\s+implements\s+(?P<impl>[^{]+))?"), ("Interface", r"(?m)^[ \t]*interface\s+(?P<name>\w+)"), ("Function", r"(?m)^[ \t]*(?P<lead>(?:(?:public|private|protected|static|abstract)\s+)*)function\s+(?P<name>\w+)\s*\(")],
}
_OTHER |= {"csharp": _OTHER["java"], "cpp": _OTHER["c"]}
_IMPORTS = {
    "go": r'(?m)^(?:import\s+)?[ \t]*(?:(?P<name>\w+)[ \t]+)?"(?P<source>[\w./-]+)"[ \t]*$', "rust": r"(?m)^[ \t]*(?:pub\s+)?use\s+(?P<source>[\w:]+)", "java": r"(?m)^import\s+(?:static\s+)?(?P<source>[\w.*]+);",
    "csharp": r"(?m)^using\s+(?:static\s+)?(?P<source>[\w.]+);", "c": r'(?m)^[ \t]*#[ \t]*include[ \t]+[<"](?P<source>[^>"]+)[>"]', "cpp": r'(?m)^[ \t]*#[ \t]*include[ \t]+[<"](?P<source>[^>"]+)[>"]',
    "ruby": r"""(?m)^[ \t]*require(?:_relative)?[ \t(]+['"](?P<source>[^'"]+)['"]""", "php": r"(?m)^use\s+(?P<source>[\w\\]+)(?:\s+as\s+(?P<name>\w+))?;",
}
_CALL = re.compile(r"(?P<pre>\bawait\s+|\bnew\s+)?(?:(?P<recv>[\w$.\]]+)(?:\.|->|::))?(?P<name>[A-Za-z_$][\w$]*)\s*\(")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "sizeof", "func", "fn", "def", "class", "elif", "and", "or", "not", "in", "super", "await", "new", "import", "require_relative", "foreach", "match", "using", "lock"}
_TEXT_ARG = re.compile(r"""\s*(['"`])((?:\\.|(?!\1)[^\\])*)\1""", re.S)


def _js_imports(text: str, code: str) -> list[dict]:
    out = []
    for m in re.finditer(r"""(?m)^[ \t]*import\s+(?P<only>type\s+)?(?P<what>[^'"`;]*?)\s*(?:from\s*)?['"](?P<source>[^'"]+)['"]""", text):
        if code[m.start() : m.start("what")].strip()[:6] != "import":
            continue
        what, source, only = m["what"], m["source"], bool(m["only"])
        names = re.search(r"\{([^}]*)\}", what)
        for part in names.group(1).split(",") if names else []:
            words = part.split()
            if words:
                typed = words[0] == "type" and len(words) > 1
                words = words[1:] if typed else words
                out.append({"source": source, "name": words[-1], "original": words[0] if len(words) == 3 else None, "is_type_only": only or typed})
        rest = re.sub(r"\{[^}]*\}", "", what).replace(",", " ").split()
        if "*" in rest:
            out.append({"source": source, "name": rest[-1], "original": "*", "is_type_only": only})
            rest = rest[: rest.index("*")]
        out += [{"source": source, "name": w, "original": "default", "is_type_only": only} for w in rest if w not in ("as", "from")]
        if not what.strip():
            out.append({"source": source, "name": None, "original": None, "is_type_only": only})
    return out


def braces_file(text: str, lang: str) -> dict:
    """Any language but Python."""
    hashes = lang in ("ruby",)
    code = blanked(text, hashes)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(at):
        import bisect

        return bisect.bisect_right(starts, at)

    script = lang in ("typescript", "tsx", "javascript")
    definitions, exports, classes, taken = [], [], [], set()
    for kind, p in _JS if script else [(k, re.compile(p)) for k, p in _OTHER.get(lang, [])]:
        for m in p.finditer(code):
            g = m.groupdict()
            name, lead = g["name"], g.get("lead") or ""
            if name in _NOT_METHODS or name in _KEYWORDS or m.start("name") in taken:
                continue
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            if lang == "ruby":
                done = re.compile(rf"(?m)^{g['ind']}end\b").search(code, m.end())
                end = done.end() if done else m.end()
            else:
                end = _block_end(code, m.end() - (1 if m.group().endswith("{") else 0))
            owner = next((c["name"] for a, b, c in classes if a < at < b), None)
            if kind == "Method" and script and owner is None:
                continue
            if kind == "Function" and owner is not None and lang in ("ruby", "php", "rust"):
                kind = "Method"
            taken.add(m.start("name"))
            shown = name[:1].isupper() if lang == "go" else "pub" in lead if lang == "rust" else "public" in lead if lang in ("java", "csharp") else "export" in lead if script and kind != "Method" else True
            before = code[: at].rstrip().rsplit("\n", 4)[1:]
            marks = re.findall(r"@([\w$.]+)", " ".join(x for x in before if x.strip().startswith("@"))) if lang in ("java", "typescript", "tsx") else []
            d = _definition(
                name, kind, line(at), line(max(at, end - 1)), signature=(name + (g.get("args") or ""))[:200] if g.get("args") else None, return_type=(g.get("ret") or "").strip() or None,
                is_exported=shown, is_default="default" in lead, is_async="async" in lead or bool(g.get("mod")), is_static="static" in lead, is_abstract="abstract" in lead, decorators=marks,
                receiver=g.get("recv") or owner, implements=[x.strip().split("<")[0] for x in (g.get("impl") or "").split(",") if x.strip()], extends_clause=(g.get("base") or None),
            )
            definitions.append(d)
            if kind in ("Class", "Interface"):
                classes.append((at, end, d))
            if shown and owner is None and kind != "Method":
                exports.append(name)
    imports = _js_imports(text, code) if script else [{"source": m["source"], "name": m.groupdict().get("name") or re.split(r"[./:\\]+", m["source"])[-1], "original": None, "is_type_only": False} for m in re.finditer(_IMPORTS[lang], text)] if lang in _IMPORTS else []
    calls, routes, groups = [], [], []
    declared = {(d["name"], d["start_line"]) for d in definitions}
    for m in _CALL.finditer(code):
        name, receiver = m["name"], m["recv"]
        at = line(m.start("name"))
        if name in _KEYWORDS or (not receiver and (name, at) in declared):
            continue
        full = f"{receiver}.{name}" if receiver else name
        arg = _TEXT_ARG.match(text, m.end())
        first = arg.group(2) if arg else None
        tail = text[m.end() : m.end() + 400]
        chosen = re.search(r"""\bmethod\s*:\s*['"](\w+)['"]""", tail) if full in ("fetch", "axios") else None
        url, method = _request(full, [first] if first else [], chosen.group(1).upper() if chosen else None)
        close = _call_end(code, m.end())
        if first is not None and full in TEST_GROUPS:
            groups.append((m.start(), close, first.replace(">", "-")))
        elif first is not None and full in TEST_LEAVES:
            chain = [t for a, b, t in groups if a < m.start() < b] + [first.replace(">", "-")]
            definitions.append(_definition(">".join(chain), "Test", at, line(close), is_exported=False))
        if receiver and first and first.startswith("/") and receiver.split(".")[-1] in ROUTERS and name.lower() in [*VERBS, "all", "use", "route", "handlefunc", "handle"]:
            handler = re.search(r",\s*([\w$.]+)\s*\)?\s*$", code[m.end() : close].rstrip(")").rstrip())
            routes.append({"method": name.upper() if name.lower() in VERBS else "*", "route_path": first, "handler": handler.group(1) if handler else None, "line": at})
        inner = code[m.end() : max(m.end(), close - 1)]
        args = 0 if not text[m.end() : max(m.end(), close - 1)].strip() else 1 + sum(1 for _ in re.finditer(",", re.sub(r"\([^()]*\)|\{[^{}]*\}|\[[^\[\]]*\]", "", inner)))
        calls.append({"callee": name, "receiver": receiver, "line": at, "is_async": (m["pre"] or "").startswith("await") or code[close : close + 6].startswith(".then("), "is_new": (m["pre"] or "").startswith("new"), "args": args, "url": url, "http_method": method})
    opened = len(re.findall(r"[{(\[]", code)) - len(re.findall(r"[})\]]", code))
    definitions.sort(key=lambda d: (d["start_line"], -d["end_line"]))
    return {"definitions": definitions, "imports": imports, "calls": calls, "routes": routes, "exports": exports, "has_error": opened != 0, "first_error_line": len(starts) if opened else None}


def _call_end(code: str, at: int) -> int:
    depth = 1
    for m in re.finditer(r"[()]", code[at:]):
        depth += 1 if m.group() == "(" else -1
        if not depth:
            return at + m.end()
    return len(code)


def typeof_sites(text: str) -> list[dict]:
    """Sites of typeof queries, line by line; whole-line, block and trailing comments are left out."""
    out, block = [], False
    for i, row in enumerate(text.split("\n"), 1):
        if block:
            block = "*/" not in row
            continue
        lead = row.lstrip()
        if lead.startswith("/*"):
            block = "*/" not in lead[2:]
            continue
        row = row.split("//", 1)[0]
        for name, p in TYPEOF:
            for m in p.finditer(row):
                out.append({"symbol": m.group(1), "pattern": name, "line": i, "context": row[max(0, m.start() - 10) : m.end() + 20].strip()})
    return out


def parse_file(path: str, text: str | None, lang: str | None) -> dict | None:
    """Everything extracted from one file, or None where its language or text is unknown or it cannot be read."""
    if text is None or lang is None:
        return None
    try:
        out = python_file(text) if lang == "python" else braces_file(text, lang)
        out["typeof_sites"] = typeof_sites(text) if lang in ("typescript", "tsx") else []
    except Exception:  # one unreadable file must not end the run
        return None
    return {"path": path, "language": lang, "line_count": text.count("\n") + 1, **out}


def extract(files: DataFrame, path: str = "rel_path", text: str = "text") -> DataFrame:
    """One row per readable file, see ``SCHEMA``."""
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text"), language(F.col(path)).alias("language")).where("language IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for b in batches:
            found = [r for p, t, n in zip(b["path"], b["text"], b["language"]) if (r := parse_file(p, t, n)) is not None]
            out = pd.DataFrame(found, columns=names)
            out["first_error_line"] = out["first_error_line"].astype("Int32")
            yield out

    return rows.mapInPandas(run, SCHEMA)


def flat(parsed: DataFrame, what: str) -> DataFrame:
    """path, ordinal and the fields of one kind of extracted rows (definitions, imports, calls, routes, typeof_sites)."""
    return parsed.select("path", F.posexplode(what).alias("ordinal", "_x")).select("path", "ordinal", "_x.*")
