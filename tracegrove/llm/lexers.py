"""Tokens of the source languages, as the grammars of ``grammars`` name them.

``tokens(language, text)`` gives three lists: the kinds (a keyword's or operator's own text, or a class
such as NAME, NUM, STR), whether a line break stands before each token, and each token's offset. The
last token is EOF. What no rule covers becomes BAD, which no grammar accepts.
"""

from __future__ import annotations

import re
from sys import intern

# The reserved words of each language.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Generic _Static_assert static_assert _Alignas _Alignof _Complex asm __asm__ __asm",
    "csharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while async partial await",
    "ruby": "BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield",
    "sql": "select from where group by having order limit offset union intersect except all distinct insert into values update set delete create table view index on as and or not in is null like ilike between exists case when then else end join inner left right full outer cross using primary key foreign references unique check default constraint alter add drop column with asc desc cast replace temp temporary if begin commit rollback truncate grant revoke to over partition rows range unbounded preceding following current row returning recursive materialized natural true false",
}
# Words with a meaning in some places only; the grammars let them stand as names too.
KEYWORDS["javascript"] += " let async of get set static from as await yield"
KEYWORDS["typescript"] = KEYWORDS["javascript"] + " type interface declare namespace module abstract readonly public private protected satisfies is asserts keyof infer override implements unique accessor"
_WORDS = {k: {w: intern(w) for w in v.split()} for k, v in KEYWORDS.items()}

_NUM = r"0[xX][0-9a-fA-F_]+\w*|0[bBoO][0-9_]+\w*|(?:[0-9][0-9_]*\.?(?:[0-9][0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?(?:[fFdDlLuUnjJmM]{0,3})(?:(?<=[0-9_])(?:[iu](?:8|16|32|64|128|size)|f(?:32|64)))?(?!\w)"
_DQ, _SQ = r'"(?:[^"\\\n]|\\(?s:.))*"', r"'(?:[^'\\\n]|\\(?s:.))*'"
_BLOCK = r"/\*(?s:.*?)\*/"
_OPS = {
    "python": r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|<=|>=|==|!=|[-+*/%@&|^]=|[-+*/%@&|^~<>()\[\]{},:.;=!]",
    "javascript": r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|[-+*/%&|^]=|\*\*|<<|[-+*/%&|^~<>()\[\]{},:.;=!?@#]",
    "java": r"->|::|\.\.\.|<<=|>>=|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|[-+*/%&|^~<>()\[\]{},:.;=!?@]",
    "go": r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|&\^|[-+*/%&|^]=|<<|>>|[-+*/%&|^~<>()\[\]{},:.;=!]",
    "rust": r"<<=|\.\.\.|\.\.=|::|->|=>|&&|\|\||==|!=|<=|>=|\.\.|[-+*/%&|^]=|<<|[-+*/%&|^~<>()\[\]{},:.;=!?@#$]",
    "c": r"<<=|>>=|\.\.\.|->|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|>>|[-+*/%&|^~<>()\[\]{},:.;=!?]",
    "csharp": r"\?\?=|<<=|=>|::|->|\?\?|\?\.|\.\.|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|[-+*/%&|^~<>()\[\]{},:.;=!?@]",
    "ruby": r"\*\*=|<=>|===|&&=|\|\|=|<<=|>>=|\.\.\.|\*\*|=>|->|::|&\.|&&|\|\||==|!=|=~|!~|<=|>=|\.\.|[-+*/%&|^]=|<<|>>|[-+*/%&|^~<>()\[\]{},:.;=!?]",
    "sql": r"<>|<=|>=|!=|\|\||::|->>|->|:=|[-+*/%<>()\[\]{},.;=:?@&|^~]",
}
_OPS["typescript"] = _OPS["javascript"]
# In order: what is skipped, strings, names.
_SHAPE = {
    "python": (r"#[^\n]*|\\\r?\n", r"(?i:[rbuft]{0,3})(?:\"\"\"(?:[^\\]|\\(?s:.))*?\"\"\"|'''(?:[^\\]|\\(?s:.))*?'''|" + _DQ + "|" + _SQ + ")", r"[^\W\d]\w*"),
    "javascript": (r"//[^\n]*|" + _BLOCK + r"|\A#![^\n]*", _DQ + "|" + _SQ, r"\#?[^\W\d][\w$]*|[$][\w$]*"),
    "java": (r"//[^\n]*|" + _BLOCK, r'"""(?s:.*?)(?<!\\)"""|' + _DQ + "|" + _SQ, r"[^\W\d][\w$]*|[$][\w$]*"),
    "go": (r"//[^\n]*|" + _BLOCK, r"`[^`]*`|" + _DQ + "|" + _SQ, r"[^\W\d]\w*"),
    "rust": (r"//[^\n]*|" + _BLOCK + r"|\A\#!(?!\[)[^\n]*", r'b?r(?P<h>#*)"(?s:.*?)"(?P=h)|b?"(?:[^"\\]|\\(?s:.))*"|b?\'(?:[^\'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))\'', r"'(?=\w)[^\W\d]\w*|(?:r\#)?[^\W\d]\w*"),
    "c": (r"//(?:[^\n\\]|\\(?s:.))*|" + _BLOCK + r"|(?m:^)[ \t]*\#(?:[^\n\\/]|\\(?s:.)|/(?!\*)|" + _BLOCK + r")*|\\\r?\n", r"(?:u8|[uUL])?(?:" + _DQ + "|" + _SQ + ")", r"[^\W\d]\w*"),
    "csharp": (r"//[^\n]*|" + _BLOCK + r"|(?m:^)[ \t]*\#[^\n]*", r'@"(?:[^"]|"")*"|"""(?s:.*?)"""|' + _DQ + "|" + _SQ, r"@?[^\W\d]\w*"),
    "ruby": (r"#[^\n]*|(?m:^)=begin\b(?s:.*?)(?m:^)=end\b[^\n]*|\\\r?\n", r"\"(?:[^\"\\#]|\\(?s:.)|#(?!\{))*\"|'(?:[^'\\]|\\(?s:.))*'|`(?:[^`\\]|\\(?s:.))*`|%[qQwWiI]?\((?:[^()\\]|\\(?s:.))*\)|%[qQwWiI]?\[[^\]]*\]|%[qQwWiI]?\{[^}]*\}", r"[@$]{0,2}[^\W\d]\w*(?:[?!](?![=~]))?|:(?:[^\W\d]\w*[?!=]?(?![:>~=])|\")"),
    "sql": (r"--[^\n]*|" + _BLOCK, r"(?i:[enbx])?'(?:[^']|'')*'|\$(?P<h>(?:[A-Za-z_]\w*)?)\$(?s:.*?)\$(?P=h)\$", r"\"(?:[^\"]|\"\")+\"|`[^`]+`|[^\W\d][\w$]*|[@:$]\w+"),
}
_SHAPE["typescript"] = _SHAPE["javascript"]
_PY_NUM = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*[jJ]?|[jJ])|(?:[1-9](?:_?[0-9])*|0(?:_?0)*))(?!\w)"
# Where a string with code in it may begin (a part of the scan): what closes it is told by what opens it.
_INTERPOLATED = {
    "javascript": "|(?P<ins>`)", "typescript": "|(?P<ins>`)", "csharp": r"|(?P<ins>\$(?:@\"|\"\"\"|\")|@\$\")",
    "ruby": r"|(?P<ins>[\"`]|%[QWIx]?[(\[{|!](?!\s)(?=[^\n]*\#\{))",
}
_POINT_FIRST = r"|\.[0-9][0-9_]*"  # .5 is no number in Rust and Ruby
_SCAN = {
    k: re.compile(rf"[ \t\r\f\v\xa0]*(?:(?P<nl>\n)|(?P<skip>{skip}){_INTERPOLATED.get(k, '')}|(?P<str>{string})|(?P<num>{_PY_NUM if k == "python" else _NUM.replace(_POINT_FIRST, "") if k in ("rust", "ruby") else _NUM})|(?P<name>{name})|(?P<op>{_OPS[k]})|(?P<end>\Z))")
    for k, (skip, string, name) in _SHAPE.items()
}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_HEREDOC = re.compile(r"<<([~-]?)(['\"]?)([A-Za-z_]\w*)\2")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => == === != !== <= >= && || ?? += -= *= return typeof instanceof in of new delete void throw case do else".split())
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")
_GO_ENDS = frozenset("NAME NUM STR break continue fallthrough return ++ -- ) ] }".split())
# After these a Ruby line goes on.
_RUBY_GOES_ON = frozenset("+ - * / % & | ^ < > ( [ { , . = ! ? && || == != <= >= => << >> += -= *= /= **  and or not :: &. ||= &&= .. ... =~ ->".split())


# Strings with code in them: what may stand before the next piece of code (group 2 opens it) or the end (group 1).
_MODES: dict[tuple[str, str], re.Pattern] = {}


def _mode(language: str, quote: str) -> re.Pattern:
    """The text of a string of ``language`` that ``quote`` closes, up to its end or to code."""
    found = _MODES.get((language, quote))
    if found is None:
        end = re.escape(quote)
        one = re.escape(quote[0])
        more = rf"|{one}(?!{one * 2})" if len(quote) == 3 else ""
        if language == "python":
            text = rf"\\N\{{[^}}\n]*\}}|\\(?s:.)|\{{\{{|\}}\}}|[^\\{{}}{one}{'' if more else chr(92) + 'n'}]{more}"
            found = rf"(?:{text})*+(?:({end})|(\{{))"
        elif language == "csharp" and quote == '@"':
            found = r'(?:[^"{}]|""|\{\{|\}\})*+(?:("(?!"))|(\{))'
        elif language == "csharp":
            text = r'\\.|\{\{|\}\}|[^"\\{}\n]' if quote == '"' else r'[^"{}]|"(?!"")'
            found = rf"(?:{text})*+(?:({end})|(\{{))"
        elif language == "ruby":
            found = rf"(?:\\(?s:.)|#(?!\{{)|[^\\#{one}])*+(?:({end})|(#\{{))"
        else:
            found = r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*+(?:(`)|(\$\{))"
        found = _MODES[language, quote] = re.compile(found)
    return found


_F_STRING = re.compile(r"(?i:[rbu]?[ft][r]?)(\"\"\"|\'\'\'|\"|\')")
_SPEC = re.compile(r"[^{}\n]*+(?:(\})|(\{))")


def _python(text: str):
    kinds, breaks, at = [], [], []
    scan, words = _SCAN["python"].match, _WORDS["python"]
    # ``held``: brackets that are open, and for each piece of code in a string the text that goes on behind it.
    indents, held, pos, n, fresh = [0], [], 0, len(text), True

    def put(kind, where):
        kinds.append(kind), breaks.append(0), at.append(where)

    def string(mode, pos):
        """Reads a string's text from ``pos``: to its end, or into the code that follows."""
        m = mode.match(text, pos)
        if not m:
            put("BAD", pos)
            return n
        if m.group(2) is not None:
            put("F{", m.end() - 1)
            held.append(mode)
        elif mode is _SPEC:
            put("F}", m.end() - 1)
            return string(held.pop(), m.end())
        else:
            put("FEND", m.end() - 1)
        return m.end()

    while pos < n:
        if fresh and not held:  # the indentation of a line that isn't blank
            fresh = False
            m = _INDENT.match(text, pos)
            pos = m.end()
            if pos >= n:
                break
            if text[pos] not in "\n#":
                width = 0
                for ch in m.group():
                    width = width + 8 - width % 8 if ch == "\t" else 0 if ch == "\f" else width + 1
                if width > indents[-1]:
                    indents.append(width)
                    kinds.append("INDENT"), breaks.append(1), at.append(pos)
                else:
                    while width < indents[-1]:
                        indents.pop()
                        kinds.append("DEDENT"), breaks.append(1), at.append(pos)
                    if width != indents[-1]:
                        kinds.append("BAD"), breaks.append(1), at.append(pos)
        m = scan(text, pos)
        kind = m.lastgroup if m else "bad"
        if kind == "skip":
            pos = m.end()
            continue
        if m:
            pos = m.start(kind)
        if kind == "name":
            word = m.group(kind)
            k = words.get(word, "NAME")
            if k == "NAME" and len(word) <= 2 and text[m.end() : m.end() + 1] in _QUOTES and (f := _F_STRING.match(text, pos)):
                put("FSTART", pos)
                pos = string(_mode("python", f.group(1)), f.end())
                continue
        elif kind == "op":
            k = intern(m.group(kind))
            if k in _OPEN:
                held.append(k)
            elif held:
                top = held[-1]
                if k in _CLOSE:
                    held.pop()
                    if type(top) is not str:
                        put("F}" if k == "}" else "BAD", pos)
                        pos = string(top, m.end())
                        continue
                elif k == ":" and type(top) is not str:  # what follows formats the value
                    put("F:", pos)
                    pos = string(_SPEC, m.end())
                    continue
        elif kind == "nl":
            pos += 1
            if not held:
                fresh = True
                if kinds and kinds[-1] not in ("NL", "INDENT", "DEDENT"):
                    put("NL", pos - 1)
            continue
        elif kind == "end":
            break
        elif kind == "str":
            k = "STR"
            if text[pos] in "fFtTrRbBuU" and (f := _F_STRING.match(text, pos)):
                put("FSTART", pos)
                pos = string(_mode("python", f.group(1)), f.end())
                continue
        else:
            k = "NUM" if kind == "num" else "BAD"
        put(k, pos)
        pos = m.end() if m else pos + 1
    if held:
        put("BAD", n)
    if kinds and kinds[-1] not in ("NL", "INDENT", "DEDENT"):
        put("NL", n)
    for _ in indents[1:]:
        put("DEDENT", n)
    return kinds, breaks, at


_QUOTES = frozenset("\"'")
_INDENT = re.compile(r"[ \t\f\r]*")


def _ruby_ends(text, pos) -> bool:
    """Whether the line break at ``pos`` ends a Ruby statement: not if the next line begins with a dot."""
    return _DOT_NEXT.match(text, pos) is None


_DOT_NEXT = re.compile(r"(?:\s|#[^\n]*\n)*(?:&\.|\.(?!\.))")


def tokens(language: str, text: str) -> tuple[list[str], list[int], list[int]]:
    """The tokens of ``text``; a byte order mark and any line ending are accepted."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if language == "python":
        kinds, breaks, at = _python(text)
        kinds.append("EOF"), breaks.append(1), at.append(len(text))
        return kinds, breaks, at
    kinds, breaks, at = [], [], []
    scan, words = _SCAN[language].match, _WORDS[language]
    script, go, ruby, sql = language in ("javascript", "typescript"), language == "go", language == "ruby", language == "sql"
    rust, java, csharp = language == "rust", language == "java", language == "csharp"
    pos, n, broke = 0, len(text), 1
    closers: list = []  # open brackets, and for each piece of code in a string the text that goes on behind it
    control: list[bool] = []  # whether an open parenthesis belongs to if, while, for, with
    behind_control = False
    heredocs: list[str] = []
    loop = -1  # brackets open where a Ruby loop waits for its do

    def string(mode, pos):
        m = mode.match(text, pos)
        if not m:
            kinds.append("BAD"), breaks.append(0), at.append(pos)
            return n
        if m.group(2) is not None:
            kinds.append("F{"), breaks.append(0), at.append(m.end() - 1)
            closers.append(mode)
        else:
            kinds.append("FEND"), breaks.append(0), at.append(m.end() - 1)
        return m.end()

    while pos < n:
        m = scan(text, pos)
        kind = m.lastgroup if m else "bad"
        if kind == "h":
            kind = "str"
        if m:
            pos = m.start(kind)
        if kind == "ins":
            opener = m.group(kind)
            mode = _mode(language, _CLOSES.get(opener) or _CLOSES.get(opener[-1], opener[-1]))
            first = mode.match(text, m.end())
            if first is None or first.group(2) is not None or language == "csharp":
                kinds.append("FSTART"), breaks.append(broke), at.append(pos)
                pos = string(mode, m.end())
            else:  # no code in it
                kinds.append("STR"), breaks.append(broke), at.append(pos)
                pos = first.end()
            broke = 0
            continue
        if kind == "end":
            break
        if kind == "skip":
            if rust and text.startswith("/*", pos):
                end = _nested_comment(text, pos)
                if end < 0:
                    kinds.append("BAD"), breaks.append(0), at.append(pos)
                    pos = n
                    continue
            else:
                end = m.end()
            if not broke and "\n" in text[pos:end]:
                broke = 1
                if go and kinds and kinds[-1] in _GO_ENDS:
                    kinds.append(";"), breaks.append(0), at.append(pos)
            pos = end
            continue
        if kind == "nl":
            if go and kinds and kinds[-1] in _GO_ENDS and not broke:
                kinds.append(";"), breaks.append(0), at.append(pos)
            elif ruby and kinds and kinds[-1] != "NL" and kinds[-1] not in _RUBY_GOES_ON and not (closers and closers[-1] in ("(", "[")) and _ruby_ends(text, pos):
                kinds.append("NL"), breaks.append(0), at.append(pos)
                loop = -1 if loop == len(closers) else loop
            broke = 1
            pos += 1
            for name in heredocs:  # their texts follow the line that opens them
                close = re.compile(rf"^[ \t]*{name}[ \t]*$", re.M).search(text, pos)
                pos = min(n, close.end()) if close else n
                if not close:
                    kinds.append("BAD"), breaks.append(1), at.append(n)
            heredocs.clear()
            continue
        end = m.end() if m else pos + 1
        last = kinds[-1] if kinds else ""
        if kind == "name":
            word = m.group(kind)
            k = words.get(word.lower() if sql else word, "NAME")
            if ruby:
                if word[0] == ":":
                    k = "STR"
                    if word == ':"':
                        s = scan(text, pos + 1)
                        end, k = (s.end(), "STR") if s else (end, "BAD")
                elif k != "NAME" and last in (".", "&."):
                    k = "NAME"
                elif last in ("def", ".") and text[end : end + 1] == "=" and text[end + 1 : end + 2] not in ("=", "~", ">") and (last == "def" or len(kinds) > 2 and kinds[-3] == "def"):
                    end += 1  # the name of a setter
                elif k in ("while", "until", "for") and (last in _RUBY_BEGINS or last in _RUBY_GOES_ON):
                    loop = len(closers)
                elif k == "do" and loop == len(closers):
                    k, loop = "DOLOOP", -1
            elif sql:
                k = _sql_word(text, pos, end, word.lower(), k, last)
            elif k != "NAME" and script and last in (".", "?."):
                k = "NAME"  # a property may be called as a keyword
            elif java and word == "yield" and last in (";", "{", "}", ":", "->") and _YIELDS.match(text, end):
                k = "yield"
        elif kind == "op":
            k = intern(m.group(kind))
            if script and k in ("/", "/=") and (last in _BEFORE_REGEX or not last or last == ")" and behind_control):
                r = _REGEX.match(text, pos)
                if r:
                    k, end = "STR", r.end()
            elif ruby and k == "<<" and (h := _HEREDOC.match(text, pos)) and (h.group(1) or not last or last in _RUBY_GOES_ON or last == "NL"):
                heredocs.append(h.group(3))
                k, end = "STR", h.end()
            elif ruby and k in ("/", "/=") and (not last or last in _RUBY_GOES_ON or last in ("NL", "if", "unless", "when", "and", "or")):
                r = _REGEX.match(text, pos)
                if r:
                    k, end = "STR", r.end()
            elif ruby and k == "?" and (c := _RUBY_CHAR.match(text, pos)) and (not last or last in _RUBY_GOES_ON or last in _RUBY_BEGINS):
                k, end = "STR", c.end()
            elif sql and k == "[" and last not in ("NAME", ")", "]") and (c := _BRACKETED.match(text, pos)):
                k, end = "NAME", c.end()
            if k in _OPEN:
                closers.append(k)
                if k == "(":
                    control.append(last in ("if", "while", "for", "with"))
            elif k in _CLOSE and closers:
                top = closers.pop()
                if k == ")" and control:
                    behind_control = control.pop()
                if type(top) is not str:
                    kinds.append("F}" if k == "}" else "BAD"), breaks.append(0), at.append(pos)
                    pos = string(top, end)
                    continue
            elif k == ":" and closers and csharp and type(closers[-1]) is not str:
                f = _FORMAT.match(text, end)
                k, end = "F:", f.end()
            elif k == ";" and loop == len(closers):
                loop = -1
        elif kind == "str":
            k = "STR"
        elif kind == "num":
            k = "NUM"
            if ruby and text[end - 1] == ".":  # 3.times
                end -= 1
            elif text[end - 1] == "." and text[end : end + 1] == ".":  # 0..9
                end -= 1
        else:
            k = "BAD"
        kinds.append(k), breaks.append(broke), at.append(pos)
        broke = 0
        pos = end
    if any(type(c) is not str for c in closers):
        kinds.append("BAD"), breaks.append(0), at.append(n)
    if go and kinds and kinds[-1] in _GO_ENDS:
        kinds.append(";"), breaks.append(0), at.append(n)
    if ruby and kinds and kinds[-1] != "NL":
        kinds.append("NL"), breaks.append(0), at.append(n)
    kinds.append("EOF"), breaks.append(1), at.append(n)
    return kinds, breaks, at


_CLOSES = {'$@"': '@"', '@$"': '@"', '$"': '"', '$"""': '"""', "(": ")", "[": "]", "{": "}"}
_FORMAT = re.compile(r"[^{}\"\n]*")
_YIELDS = re.compile(r"[ \t]*[^\s=.]")
_RUBY_CHAR = re.compile(r"\?(?:\\.|[^\s\\])(?!\w)")
_RUBY_BEGINS = frozenset("NL ; then do DOLOOP else begin ensure { ( |".split()) | {""}
_BRACKETED = re.compile(r"\[[A-Za-z_][\w ]*\]")
_COMMENT_EDGE = re.compile(r"/\*|\*/")


def _nested_comment(text: str, pos: int) -> int:
    """Behind the comment that begins at ``pos`` and may hold others, or -1."""
    depth = 0
    for m in _COMMENT_EDGE.finditer(text, pos):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


# Words that begin statements which are taken as they are, and kinds of things that are created so.
_COMMANDS = frozenset("explain set comment vacuum use declare call pragma show analyze exec execute lock copy load refresh reindex prepare deallocate describe savepoint release cluster checkpoint".split())
_OBJECTS = frozenset("function procedure trigger sequence type schema database role user extension domain policy rule aggregate operator event server publication subscription collation tablespace".split())
_SQL_AHEAD = {
    "fetch": re.compile(r"(?i)\s+(?:first|next)\b"), "window": re.compile(r"(?i)\s+\w+\s+as\s*\("), "merge": re.compile(r"(?i)\s+(?:into\b|\w[\w.]*\s+(?:as\s+)?(?:\w+\s+)?using\b)"),
    "use": re.compile(r"(?i)\s+(?:\w+|`[^`]+`|\[[^\]]+\])\s*(?:;|\Z|\n)"), "set": re.compile(r"(?i)\s+[@\w.]+\s*(?:=|to\b|:=|on\b|off\b|\w)"),
}


def _sql_word(text: str, pos: int, end: int, word: str, kind: str, last: str) -> str:
    """The kind of a word that means something only in its place."""
    ahead = _SQL_AHEAD.get(word)
    if word in _COMMANDS and last in ("", ";") and (ahead is None or ahead.match(text, end)):
        return "CMD"
    if word in _OBJECTS and last in ("create", "replace"):
        return "OBJ"
    if word == "for" or word in ("fetch", "window", "merge") and ahead.match(text, end):
        return word
    return kind
