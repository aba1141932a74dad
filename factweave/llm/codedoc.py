"""Functions paired with their documentation (problem 3).

Island grammars per language: the text is masked first (strings, comments and, in JavaScript,
templates become blanks of the same length, so that code inside them is never read), then a scanner
looks for the islands only: documentation, annotations, signatures and balanced bodies. Everything
else is water and skipped. Nothing is parsed that is not needed, so broken or unknown syntax between
the islands does no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Pair(NamedTuple):
    """A function with its documentation (None if it has none), its code and its place."""

    owner_id: str
    name: str
    kind: str
    documentation: str | None
    code: str
    line: int


_GO_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|`[^`]*(?:`|\Z)|'(?:\\.|[^'\\\n])+'", re.S)
_PY_TOKEN = re.compile(r"\#[^\n]*|([bBfFrRuUtT]{0,2})(\"\"\"|''')(?:\\.|(?!\2).)*(?:\2|\Z)|([bBfFrRuUtT]{0,2})(\"|')(?:\\.|(?!\4)[^\\\n])*\4?", re.S)
_JS_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`|(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[dgimsuvy]*", re.S)
_BLANK = re.compile(r"[^\n]")


def _mask(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], _BLANK.sub(" ", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def _template_end(text: str, at: int) -> int:
    """The place after a JavaScript template that opens before ``at``; its expressions may hold others."""
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif c == "$" and text[at + 1 : at + 2] == "{":
            depth, at = 1, at + 2
            while at < n and depth:
                c = text[at]
                if c == "`":
                    at = _template_end(text, at + 1)
                    continue
                depth += (c == "{") - (c == "}")
                at += 1
        else:
            at += 1
    return n


def _tokens(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Spans of comments and literals, from left to right."""
    spans, at = [], 0
    while m := pattern.search(text, at):
        start, end = m.span()
        if m[0] == "`":
            end = _template_end(text, end)
        elif "/" in m[0][:1] or m[0][:1] in "\"'`#" or pattern is _PY_TOKEN:
            pass
        else:
            start += len(m[0]) - len(m[0].lstrip())
        spans.append((start, max(end, start + 1)))
        at = max(end, m.start() + 1)
    return spans


def _body_end(masked: str, at: int) -> int:
    """The place after the braces that open at or after ``at`` balance again."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, at):
        depth += 1 if m[0] == "{" else -1
        if depth <= 0:
            return m.end()
    return len(masked)


def _comment_text(raw: str) -> str:
    """A comment without its markers."""
    if raw.startswith("//"):
        return raw[2:]
    body = raw[2:-2] if raw.endswith("*/") and len(raw) >= 4 else raw[2:]
    return "\n".join(re.sub(r"^\s*\*+ ?", "", x) for x in body.lstrip("*").split("\n"))


_GO_FUNC = re.compile(r"^func[ \t]+(?:\(\s*(?:[\w]+[ \t]+)?(\*?)\s*(\w+)(?:\[[^\]]*\])?\s*\)[ \t]*)?(\w+)[ \t]*[\[(]", re.M)


def go_pairs(text: str, pkg: str) -> Iterator[Pair]:
    """Functions and methods of a Go file; documentation is the comment touching the declaration."""
    spans = _tokens(text, _GO_TOKEN)
    masked = _mask(text, spans)
    comments = {b: (a, b) for a, b in spans if text.startswith(("//", "/*"), a) and not text[text.rfind("\n", 0, a) + 1 : a].strip()}
    for m in _GO_FUNC.finditer(masked):
        parts: list[str] = []
        at = m.start()
        while at > 0:
            end = at - 1
            while end > 0 and text[end - 1] in " \t":
                end -= 1
            if end not in comments:
                break
            a, b = comments[end]
            parts.insert(0, _comment_text(text[a:b]))
            at = text.rfind("\n", 0, a) + 1
        name = m[3]
        owner = f"{pkg}.({m[1]}{m[2]}).{name}" if m[2] else f"{pkg}.{name}"
        end = _signature_end(masked, m.end() - 1)
        yield Pair(owner, name, "method" if m[2] else "func", "\n".join(parts) if parts else None, text[m.start() : end], text.count("\n", 0, m.start()) + 1)


def _signature_end(masked: str, at: int) -> int:
    """The end of the body that follows a Go signature; of the line if it has none."""
    depth = 0
    for i in range(at, len(masked)):
        c = masked[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "{" and depth == 0 and not masked[at:i].rstrip().endswith(("interface", "struct")):
            return _body_end(masked, i)
        elif c == "\n" and depth == 0:
            return i
    return len(masked)


_PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)


def python_pairs(text: str, pkg: str) -> Iterator[Pair]:
    """Top-level functions and methods of top-level classes of a Python file, with their docstrings."""
    spans = _tokens(text, _PY_TOKEN)
    masked = _mask(text, spans)
    literals = {a: (a, b) for a, b in spans if text[a] != "#"}
    starts = [0] + [m.end() for m in re.finditer("\n", masked)]
    # columns of the lines that hold code and do not carry on a bracket
    depth, code = 0, []
    for a in starts:
        end = masked.find("\n", a)
        line = masked[a : end if end >= 0 else len(masked)]
        held = line.strip() or (a + len(line) - len(line.lstrip()) in literals)
        if depth == 0 and (line.strip() or any(x in literals for x in range(a, a + len(line) + 1) if text[x : x + 1] in "\"'rRuU")):
            first = text[a : a + len(line)]
            code.append((a, len(first) - len(first.lstrip())))
        if held:
            depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
    owner, body = None, -1
    for k, (a, column) in enumerate(code):
        m = _PY_DEF.match(masked, a)
        if column == 0:
            owner, body = None, -1
        elif owner and body < 0:
            body = column
        if not m:
            continue
        if column == 0 and m[2] == "class":
            owner = m[3]
            continue
        if m[2] == "class" or column and (not owner or column != body):
            continue
        end = next((x for x, c in code[k + 1 :] if c <= column), len(text))
        while end > a and text[end - 1].isspace():
            end -= 1
        yield Pair(f"{pkg}.{owner}.{m[3]}" if column else f"{pkg}.{m[3]}", m[3], "method" if column else "func", _docstring(text, masked, literals, m.end()), text[a:end], text.count("\n", 0, a) + 1)


def _docstring(text: str, masked: str, literals: dict[int, tuple[int, int]], at: int) -> str | None:
    """The literal that is the first statement after a signature."""
    depth, n = 0, len(masked)
    while at < n:
        c = masked[at]
        depth += (c in "([{") - (c in ")]}")
        at += 1
        if c == ":" and depth == 0:
            break
    while at < n:
        if at in literals:
            a, b = literals[at]
            m = re.match(r"([bBfFrRuUtT]{0,2})(\"\"\"|'''|\"|')", text[a:b])
            rest = masked[b:].split("\n", 1)[0].strip()
            if not m or set(m[1].lower()) & set("bft") or rest and not rest.startswith((";", "#")):
                return None
            close = len(m[2]) if text[a:b].endswith(m[2]) and b - a >= len(m[0]) + len(m[2]) else 0
            return text[a + len(m[0]) : b - close]
        if text[at] == "#":
            at = (text.find("\n", at) + 1) or n
            continue
        if not masked[at].isspace():
            return None
        at += 1
    return None


_JS_ISLAND = re.compile(
    r"""(?P<open>[{(\[])|(?P<close>[})\]])
    |(?<![\w$.])(?P<class>(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)[^{};]*)(?=\{)
    |(?<![\w$.])(?P<function>(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?=[(<]))
    |(?<![\w$.])(?P<arrow>(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s+)?(?:function\b\s*\*?\s*[\w$]*\s*(?=\()|(?=\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::\s*[^={]+)?=>)|(?=[A-Za-z_$][\w$]*\s*=>)))
    |(?<![\w$.])(?P<method>(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(\#?[A-Za-z_$][\w$]*)\s*(?=\())""",
    re.X,
)
_JS_NOT_METHODS = frozenset("if for while switch catch return function await typeof super new do else throw with".split())


def javascript_pairs(text: str, pkg: str) -> Iterator[Pair]:
    """Top-level functions and methods of top-level classes; documentation is the ``/**`` block right before."""
    spans = _tokens(text, _JS_TOKEN)
    masked = _mask(text, spans)
    blocks = {b: a for a, b in spans if text.startswith("/*", a)}
    lines = {b for a, b in spans if text.startswith("//", a)}

    def block_before(at: int) -> str | None:
        end = at
        while True:
            while end > 0 and text[end - 1].isspace():
                end -= 1
            if end in blocks:
                a = blocks[end]
                return _comment_text("/*" + text[a + 2 : end]) if text.startswith("/**", a) and end - a > 4 else None
            head = masked[masked.rfind("\n", 0, end) + 1 : end].strip()
            if end in lines or not head.startswith("@"):
                return None
            end = masked.rfind("\n", 0, end) + 1  # an annotation on a line of its own

    depth, at, owner, inside = 0, 0, None, -1
    while m := _JS_ISLAND.search(masked, at):
        at = m.end()
        if m["open"]:
            depth += 1
            continue
        if m["close"]:
            depth = max(0, depth - 1)
            if owner and depth < inside:
                owner, inside = None, -1
            continue
        if m["class"]:
            if depth == 0:
                owner, inside = m[4], 1
            continue
        named = m["function"] and m[6] or m["arrow"] and m[8]
        if named and depth == 0:
            end = _js_end(masked, at)
            yield Pair(f"{pkg}.{named}", named, "func", block_before(m.start()), text[m.start() : end], text.count("\n", 0, m.start()) + 1)
            at = end
        elif m["method"] and owner and depth == inside and m[10] not in _JS_NOT_METHODS:
            brace = _after_parameters(masked, at)
            if brace < 0:
                continue
            end = _body_end(masked, brace)
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            yield Pair(f"{pkg}.{owner}.{m[10]}", m[10], "method", block_before(start), text[start:end], text.count("\n", 0, start) + 1)
            at = end
        elif named:
            continue


def _after_parameters(masked: str, at: int) -> int:
    """The brace of the body that follows a parameter list; -1 if none does."""
    depth = 0
    for i in range(at, len(masked)):
        c = masked[i]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                m = re.compile(r"\s*(?::[^{};=]*)?\{").match(masked, i + 1)
                return m.end() - 1 if m else -1
        elif depth == 0 and not c.isspace():
            return -1
    return -1


def _js_end(masked: str, at: int) -> int:
    """The end of a function that starts with its parameters at ``at``."""
    depth = 0
    for i in range(at, len(masked)):
        c = masked[i]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "{" and depth == 0:
            return _body_end(masked, i)
        elif c == ";" and depth == 0:
            return i + 1
    return len(masked)


_READERS = {"go": go_pairs, "python": python_pairs, "javascript": javascript_pairs}
#: File extensions by language.
_EXTENSIONS = {".go": "go", ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript"}


def language_of(language: str | None, path: str | None) -> str | None:
    """The language of a file by its declared language, else by its extension."""
    if language and language.strip().lower() in _READERS:
        return language.strip().lower()
    m = re.search(r"\.\w+$", path or "")
    return _EXTENSIONS.get(m[0].lower()) if m else None


def pairs(content: str | None, pkg: str, language: str | None) -> list[Pair]:
    """All functions of a file; none for empty, null or unknown ones."""
    if not content or language not in _READERS:
        return []
    return list(_READERS[language](content.replace("\r\n", "\n").replace("\r", "\n"), pkg or ""))


_DIRECTIVE = re.compile(r"^\s*(?:go:\w+|nolint\b|lint:|\+build\b|export \w+$|line [\w.]+:\d+|noqa\b|type:\s*ignore|pylint:|flake8:|mypy:|pragma:|fmt:\s*(?:on|off|skip)|isort:|yapf:|eslint\b|eslint-|jshint\b|jslint\b|prettier-ignore|tslint:|istanbul\b|c8 ignore|v8 ignore|@ts-\w+|@flow\b|@jsx\b|@formatter|@preserve|@generated|coverage:|nosec\b|nosonar\b|swagger:|cspell:|spell-checker|#?region\b|#?endregion\b|-\*-|vim?:|webpackChunkName|sourceMappingURL|@license|@noinspection|revive:|gosec\b|exhaustive:|golint\b)", re.I)
_NOTICE = re.compile(r"copyright|\(c\)\s*\d{4}|©|all rights reserved|licen[sc]e[ds]?\b.*(?:under|terms|version|file|apache|mit|bsd|gpl)|^\s*licen[sc]e|spdx-|generated (?:by|from|code)|code generated|do not edit|permission is hereby granted|without warranty|redistribution and use|confidential|proprietary", re.I)
_TASK = re.compile(r"^\W*(?:todo|fixme|xxx|hack|wip|tbd|bug|note to self|tba)\b", re.I)
_TAG = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|returns?|throws?|exception|type|typedef|async|private|public|protected|internal|static|override|inheritdoc|see|since|version|author|deprecated|function|method|memberof|class|constructor|name|namespace|module|export|todo|ignore|hidden|readonly|abstract|virtual|yields?|property|prop|template|api|summary|description|category|group|fires|emits|listens|this|alias|access|example)\b|:(?:param|parameter|arg|argument|type|returns?|rtype|raises?|raise|var|ivar|cvar|keyword|kwarg|meta|yields?)\b[^:]*:|(?:args|arguments|parameters|params|returns?|raises|throws|yields|examples?|see also|notes?)\s*:?\s*$|(?:parameters|returns|raises)\s*\n?-{3,})", re.I)
_CODE = re.compile(r"[{};]\s*$|:=|^\s*(?:return\b|if\s.*[:{]|if\s*\(|for\s.*[:{]|for\s*\(|while\s*\(|func\s+[\w(]|def\s+\w+\s*\(|class\s+\w+\s*[:({]|import\s+[\w{\"']|from\s+\S+\s+import\b|const\s+\w+\s*=|let\s+\w+\s*=|var\s+\w+|async\s+function|function\s+\w*\s*\(|@\w+\(|else\b\s*[:{]?$|try\s*[:{]|await\s|raise\s+\w+\(|throw\s+new|log\.\w+\(|print\(|console\.)|^\s*[\w.\[\]'\"]+\s*(?:[-+*/|&]?=)\s*\S|^\s*[\w.]+\([^()]*\)\s*$|[=!]==?\s")
_PLACEHOLDERS = re.compile(
    r"""^(?:documentation|documentation\ goes\ here|docs?|doc\ goes\ here|add\ (?:docs?|documentation|comment|description)(?:\ here)?|description(?:\ (?:goes\ )?here)?|insert\ (?:description|documentation)(?:\ here)?|missing\ (?:docs?|documentation)|no\ (?:docs?|documentation|description|comment)(?:\ (?:yet|available|needed|provided))?|undocumented|to\ be\ (?:done|documented|written|determined|defined|added)|to\ do|see\ (?:above|below|name|code|implementation|there)|same\ as\ above|as\ above|ditto|self[- ]explanatory|obvious|comment|placeholder|lorem\ ipsum.*|n/?a|none|null|nil|tbd|todo|fixme|xxx|wip|hack|unknown|foo|bar|baz|test|internal|private|deprecated|not\ implemented|work\ in\ progress|coming\ soon|fill\ me\ in|write\ me|document\ (?:me|this)|summary|brief|title|function|method|field|value|ok
    |siehe\ oben|siehe\ unten|siehe\ name|siehe\ code|keine\ beschreibung|beschreibung(?:\ (?:fehlt|folgt))?|beschreibung|dokumentation(?:\ (?:fehlt|folgt))?|kommt\ noch|offen|unbekannt|ver\ arriba|voir\ ci-dessus|sin\ descripción|à\ faire|pendiente|por\ hacer
    |见上|同上|见下|如上|略|无|暂无|待补充|待定|待写|待完善|未完成|说明|描述|注释|文档|备注|暂无说明|暂无描述|暂无文档|此处填写说明|同名|如题|字段|函数|方法)$""",
    re.I | re.X,
)
#: Words that add nothing to a name.
_EMPTY_WORDS = frozenset("a an the this that these it its is are was be does do of for to in on at with by from and or as into function func method field value struct type property attribute member class object param parameter variable helper handler routine procedure implementation implements wrapper here just simply see above below main given current der die das ein eine ist des dem den für und von zu funktion methode feld wert el la los las un una de del y función método campo valor le les une et fonction méthode champ valeur".split())
_CJK = re.compile(r"[㐀-鿿]")
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W_A-Za-z]+")


def _stem(word: str) -> str:
    w = word.lower()
    if w.endswith("ies") and len(w) > 4:
        w = w[:-3] + "y"
    elif w.endswith("ing") and len(w) > 5 or w.endswith("ers") and len(w) > 6:
        w = w[:-3]
    elif w.endswith(("es", "ed", "er")) and len(w) > 4:
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss") and len(w) > 3:
        w = w[:-1]
    w = w.rstrip("e")
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def essence(documentation: str | None) -> str:
    """What is left of documentation without directives, tags, notices, tasks, code and ornaments."""
    kept, tagged, notice = [], False, False
    for line in (documentation or "").replace("\r", "").split("\n"):
        s = line.strip()
        if not s:
            tagged = False
            kept.append("")
            continue
        if _NOTICE.search(s):
            notice = True
            continue
        if _DIRECTIVE.match(s) or _TASK.match(s) or not re.search(r"\w", s):
            continue
        if _TAG.match(s):
            tagged = True
            continue
        if tagged and line[:1] in " \t":
            continue  # the text of a tag carried on
        if _CODE.search(s) and not s.endswith((".", "。")):
            continue
        kept.append(s)
    text = " ".join(x for x in kept if x)
    return "" if notice and len(text) < 20 else text


def says_something(documentation: str | None, name: str, owner: str = "") -> bool:
    """Whether documentation tells what the name does not.

    Null, empty and blank texts, placeholders, tool directives, bare tags, ornaments, notices,
    disabled code and the name in other words (with or without articles and words like *function*)
    say nothing; nor does a name with one word more.
    """
    text = essence(documentation)
    bare = re.sub(r"^[\s\W_]+|[\s\W_]+$", "", text)
    if not bare or _PLACEHOLDERS.match(bare) or _PLACEHOLDERS.match(re.sub(r"\s+", " ", text.strip(" .!:-"))):
        return False
    names = {_stem(w) for w in _NAME_WORD.findall(name) + _NAME_WORD.findall(owner)}
    whole = _stem(re.sub(r"\W|_", "", name))
    han = len(_CJK.findall(bare))
    generic = len("".join(re.findall("函数|方法|字段|的|该|此|这个|用于|处理|接口|结构|类型|值|见上|同上", bare)))
    fresh = [w for w in _NAME_WORD.findall(re.sub(r"['’]s\b", "", bare)) if not _CJK.search(w) and len(w) > 1 and w.lower() not in _EMPTY_WORDS and _stem(w) not in names and _stem(w) != whole and not w.isdigit()]
    if han - generic >= 4:
        return True
    return len(fresh) >= 2 or len(fresh) == 1 and len(fresh[0]) > 3 and len(bare.split()) != 2


def documented_functions(files: DataFrame, trivial: bool = False) -> DataFrame:
    """``owner_id, name, kind, documentation, code, file_id, line`` of the functions in each file's
    newest capture whose documentation says something (with ``trivial``, of all functions).

    Of captures tied in time the greatest content counts. Files without content or of an unknown
    language have none; a file is one row and read whole. Equal rows are one.
    """
    newest = files.groupBy("file_id").agg(F.max(F.struct("captured_at", "content", "pkg", "file_path", "prog_lang")).alias("f")).select("file_id", "f.content", "f.pkg", "f.file_path", "f.prog_lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file_id, content, pkg, path, language in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for p in pairs(content, pkg, language_of(language, path)):
                    if trivial or says_something(p.documentation, p.name):
                        out.append((p.owner_id, p.name, p.kind, p.documentation, p.code, file_id, p.line))
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.string()] * 5 + [b.schema.field(0).type, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["owner_id", "name", "kind", "documentation", "code", "file_id", "line"])

    kind = files.schema["file_id"].dataType.simpleString()
    return newest.mapInArrow(run, f"owner_id string, name string, kind string, documentation string, code string, file_id {kind}, line int")


def documented_fields(fields: DataFrame) -> DataFrame:
    """``field_id, documentation`` of the fields whose ``doc`` says something. Equal rows are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [says_something(d, n or "") for n, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 2]).rename_columns(["field_id", "documentation"])

    return fields.select("field_id", "field_name", "doc").where("doc IS NOT NULL").mapInArrow(run, "field_id string, documentation string").distinct()
