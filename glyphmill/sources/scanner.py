"""Facts of source files by a lexer and a light structural scan; a file is read once.

What is approximated: ternaries extend from delimiter to delimiter; unbraced bodies end at their semicolon, in the JavaScript
family also at the line end; functions of C++ and Java are found by their parentheses before a brace at the level of a type or file.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..languages import REGISTRY, Language

#: A row is a fact; columns that a fact doesn't have are null. ``depth`` is the number of branches around a branch, and 1 for a construct
#: in another one; ``rows`` are the rows that a comment covers and none before it does, ``bare_rows`` those of them that are comment alone.
FACTS = (
    "path string, language string, fact string, ord long, kind string, name string, start_idx long, end_idx long, start_row long,"
    " start_col long, end_row long, body_idx long, body_row long, text string, owner string, owner_kind string, names array<string>, libs array<string>, fn_ord long,"
    " depth long, rows long, bare_rows long"
)
_NAMES = [x.split()[0] for x in FACTS.split(",")]
#: The kinds of facts, but error.
ALL = frozenset(("comment", "branch", "norm", "function", "container", "call"))
#: White space as in ``functions.expressions``, and what makes a row of comment alone.
_SPACE = "[\\s\\x0b\\xa0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_WHITE = " \t\n\x0b\f\r\xa0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Beginnings of lines of comment alone among changed lines, as in ``functions.expressions.comment_only_changed``.
_CHANGED_BARE = ("//", "/*", "*", "#", "--", ";;")
_BARE = re.compile(_SPACE.replace("\\s", " \\t\\n\\x0b\\f\\r") + r"*(?://|/\*|\*|#)")
#: A batch of facts is sent on when it has so many rows or so many characters of text.
_BATCH_ROWS, _BATCH_TEXT = 20_000, 4 << 20
#: Bytes of files for a task of its own, as Spark estimates them: of a table less than it holds, behind joins much more.
_SPREAD_BYTES = 4 << 10
_KIND = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(n, _KIND[t]) for n, t in (x.split() for x in FACTS.split(","))])

_OPEN, _CLOSE = "([{", ")]}"
_NOT_CALLS = frozenset(
    "if for while switch catch return function fn func fun match loop do else try new emit revert sizeof typeof in of case throw delete await"
    " yield void assembly unchecked returns constructor modifier using import super pragma where impl struct enum trait event error circuit as"
    " abort repeat select go defer get mapping address".split()
) - {"get", "address", "super"}
_MODIFIERS = frozenset("public private protected static async get set readonly override abstract final declare export default accessor".split())


@lru_cache(64)
def _lexer(language: Language) -> re.Pattern[str]:
    name = language.name
    js = name in ("javascript", "typescript", "tsx", "flow")
    parts = [f"(?P<comment>{'|'.join(re.escape(x) + '[^\\n]*' for x in language.line)}" + (r"|/\*" if language.block else "") + ")"]
    if name == "cpp":
        parts.append(r"(?P<skip>(?m:^)[ \t]*\#(?:[^\n\\]|\\\r?\n|\\.)*)")
        parts.append(r'(?P<raw>R"\([\s\S]*?\)")')
    if name == "rust":
        parts.append(r'(?P<raw>b?r(?P<hashes>\#*)"[\s\S]*?"(?P=hashes))')
        parts.append(r"(?P<char>b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])')|(?P<life>'\w+)")
    if name in ("java", "tolk", "move"):
        parts.append(r'(?P<block>"""[\s\S]*?""")')
    quotes = r'"(?:\\[\s\S]|[^"\\\n])*"?'
    if name != "masm":
        quotes += r"|'(?:\\[\s\S]|[^'\\\n])*'?" if name != "rust" else ""
    if name == "go":
        quotes += r"|`[^`]*`?"
    if js:
        quotes += r"|`(?:\\[\s\S]|[^`\\])*`?"
    parts += [f"(?P<string>{quotes})", r"(?P<number>\d\w*(?:\.\d\w*)?)", r"(?P<word>[^\W\d][\w$]*|\$[\w$]*)", r"(?P<op>=>|->|::|\?\.|\?\?|\.\.\.?|&&|\|\||[<>=!]=|\S)"]
    return re.compile("|".join(parts))


class Source:
    """Tokens of a file and what is found among them. A token is (kind, text, start, end); comments are kept apart."""

    def __init__(self, text: str, language: Language):
        self.text, self.language = text, language
        self.js = language.name in ("javascript", "typescript", "tsx", "flow")
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens: list[tuple[str, str, int, int]] = []
        self.comments: list[tuple[int, int]] = []
        self._lex()
        self.pair: dict[int, int] = {}
        #: For each token the number of braces around it.
        self.depth: list[int] = []
        #: The innermost brace around each token, -1 if there is none, and for braces whether a type's members are in it.
        self.brace: list[int] = []
        self._types: dict[int, bool] = {-1: False}
        self._ends: dict[int, int] = {}
        self._starts: dict[int, int] = {}
        stack: list[int] = []
        depth, braces = 0, [-1]
        for i, (kind, t, _, _) in enumerate(self.tokens):
            if kind == "op" and t == "}":
                depth -= 1
                if len(braces) > 1:
                    braces.pop()
            self.depth.append(depth)
            self.brace.append(braces[-1])
            if kind == "op" and t == "{":
                depth += 1
                braces.append(i)
            if kind == "op" and t in _OPEN:
                stack.append(i)
            elif kind == "op" and t in _CLOSE:
                while stack and _OPEN.index(self.tokens[stack[-1]][1]) != _CLOSE.index(t):
                    stack.pop()
                if stack:
                    j = stack.pop()
                    self.pair[i], self.pair[j] = j, i

    def _lex(self) -> None:
        match, at, text, n = _lexer(self.language).search, 0, self.text, len(self.text)
        while at < n and (m := match(text, at)):
            kind, start, at = m.lastgroup, m.start(), m.end()
            if kind == "comment":
                if m[0] == "/*":
                    at = self._block_end(at)
                self.comments.append((start, at))
            elif kind == "op" and m[0] == "/" and self.js and self._regex_may_begin():
                m2 = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/\w*").match(text, start)
                if m2:
                    at = m2.end()
                    self.tokens.append(("string", m2[0], start, at))
                else:
                    self.tokens.append(("op", "/", start, at))
            elif kind not in ("skip", "life"):
                kind = kind if kind in ("word", "op", "number") else "string"
                self.tokens.append((kind, m[0], start, at))

    def _block_end(self, at: int) -> int:
        depth = 1
        for m in re.compile(r"/\*|\*/").finditer(self.text, at):
            depth += 1 if m[0] == "/*" and self.language.nested else -1 if m[0] == "*/" else 0
            if not depth:
                return m.end()
        return len(self.text)

    def _regex_may_begin(self) -> bool:
        if not self.tokens:
            return True
        kind, t, _, _ = self.tokens[-1]
        return kind == "op" and t not in (")", "]", "}") or kind == "word" and t in ("return", "typeof", "case", "in", "of")

    def row(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] in ("op", "word") and self.tokens[i][1] in texts

    def word(self, i: int) -> str | None:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) and self.tokens[i][0] == "word" else None

    def after(self, i: int) -> int:
        """The token behind i, or behind what i opens."""
        return self.pair.get(i, i) + 1 if self.is_(i, *_OPEN) else i + 1

    # Statements: the last token of what begins at i.

    def statement(self, i: int) -> int:
        """Else chains are followed in a loop, and their end is that of each branch in them, so their length doesn't matter."""
        n, todo, chain, end = len(self.tokens), i, [], len(self.tokens) - 1
        while todo < n:
            if todo in self._ends:
                end = self._ends[todo]
                break
            chain.append(todo)
            end, following = self._one(todo)
            if following is None:
                break
            todo = following
        else:
            end = n - 1
        self._ends.update(dict.fromkeys(chain, end))
        return end

    def _one(self, i: int) -> tuple[int, int | None]:
        """The last token of a statement, or of one with a branch and the first of what follows its else."""
        if self.is_(i, "{"):
            return self.pair.get(i, len(self.tokens) - 1), None
        w = self.word(i)
        if w == "do":
            end = self.statement(i + 1)
            if self.is_(end + 1, "while"):
                end = self.after(end + 2) - 1
                return (end + 1 if self.is_(end + 1, ";") else end), None
            return end, None
        if w == "try":
            end = self.statement(self.block_start(i + 1))
            while self.is_(end + 1, "catch", "finally"):
                end = self.statement(self.block_start(end + 2))
            return end, None
        if w in ("if", "while", "for", "switch", "match", "repeat", "loop", "select", "comptime"):
            body = self.condition_end(i)
            if body >= len(self.tokens):
                return len(self.tokens) - 1, None
            end = self.statement(body)
            return end, end + 2 if w == "if" and self.is_(end + 1, "else") else None
        return self.plain_end(i), None

    def plain_end(self, i: int) -> int:
        last = i
        while i < len(self.tokens):
            if self.is_(i, ";"):
                return i
            if self.is_(i, *_CLOSE) or self.is_(i, ","):
                return max(last, i - 1)
            if self.js and i > last and self.row(self.tokens[i][2]) > self.row(self.tokens[last][3] - 1) and not self._continues(last, i):
                return last
            nxt = self.after(i)
            last, i = nxt - 1, nxt
        return len(self.tokens) - 1

    def _continues(self, last: int, i: int) -> bool:
        kind, t, _, _ = self.tokens[last]
        return kind == "op" and t not in (")", "]", "}") or self.tokens[i][0] == "op" and self.tokens[i][1] in (".", "?.", "?", ":", "&&", "||", "=>", "+", ",")

    def block_start(self, i: int) -> int:
        while i < len(self.tokens) and not self.is_(i, "{", ";"):
            i = self.after(i)
        return i

    def condition_end(self, i: int) -> int:
        """The first token of the body of the branch that begins at i."""
        w = self.word(i)
        if w in ("loop", "comptime") or w == "select":
            return i + 1
        if self.language.paren:
            k = i + 1
            while k < len(self.tokens) and not self.is_(k, "(", "{", ";"):
                k += 1
            return self.after(k) if self.is_(k, "(") else k
        k = i + 1
        while k < len(self.tokens):
            if self.is_(k, "{"):
                end = self.pair.get(k, len(self.tokens) - 1)
                if not (self.is_(end + 1, "{") and self.row(self.tokens[end][2]) == self.row(self.tokens[end + 1][2])):
                    return k
            k = self.after(k)
        return k

    def branches(self) -> Iterator[tuple[str, int, int]]:
        words, name = self.language.branches, self.language.name
        if name == "masm":
            yield from self._ended(words)
            return
        skip: set[int] = set()
        for i, (kind, t, start, _) in enumerate(self.tokens):
            if kind == "word" and t in words and i not in skip and not self.is_(i - 1, ".", "::", "?.") and not self.is_(i + 1, ":", "="):
                if t == "do":
                    end = self.statement(i)
                    while_ = end
                    while while_ > i and not self.is_(while_, "while"):
                        while_ = self.pair[while_] - 1 if self.is_(while_, ")", "}", "]") and while_ in self.pair else while_ - 1
                    skip.add(while_)
                elif t == "catch":
                    if self.js:
                        continue
                    end = self.statement(self.block_start(i + 1))
                elif t == "abort":
                    end = self.plain_end(i)
                    end -= self.is_(end, ";") and end > i
                elif t == "comptime":
                    end = self.statement(i + 1)
                elif t in ("match", "switch", "select") and not self.is_(self.condition_end(i), "{"):
                    continue
                elif self.language.paren and t in ("if", "for", "while", "switch") and not self.is_(i + 1 + self.is_(i + 1, "await", "constexpr"), "("):
                    continue
                elif t == "for" and name == "rust" and (self.is_(i + 1, "<") or self._header_of_impl(i)):
                    continue
                else:
                    end = self.statement(i)
                yield t, start, self.tokens[min(end, len(self.tokens) - 1)][3]
            elif self.language.ternary and kind == "op" and t == "?" and not self.is_(i + 1, ":", ")", ",", "=", ">", ";", "extends"):
                got = self._ternary(i)
                if got:
                    yield "conditional", *got

    def _header_of_impl(self, i: int) -> bool:
        while i >= 0 and not self.is_(i, ";", "{", "}"):
            if self.is_(i, "impl"):
                return True
            i -= 1
        return False

    def _ternary(self, i: int) -> tuple[int, int] | None:
        a = i - 1
        while a >= 0 and not (self.is_(a, "=", "(", "[", "{", "}", ",", ";", "return", "=>", ":", "?", "throw", "case", "<") and not self.is_(a, *_CLOSE)):
            a = self.pair.get(a, a) - 1 if self.is_(a, *_CLOSE[:2]) else a - 1
        b, depth = i + 1, 1
        while b < len(self.tokens) and depth:
            if self.is_(b, "?") and not self.is_(b + 1, ".", ":"):
                depth += 1
            elif self.is_(b, ":"):
                depth -= 1
            elif self.is_(b, ";", *_CLOSE):
                return None
            b = self.after(b)
        end = b
        while end < len(self.tokens) and not self.is_(end, ";", ",", ":", *_CLOSE):
            nxt = self.after(end)
            if self.js and nxt < len(self.tokens) and self.row(self.tokens[nxt][2]) > self.row(self.tokens[nxt - 1][3] - 1) and not self._continues(nxt - 1, nxt):
                end = nxt
                break
            end = nxt
        return (self.tokens[a + 1][2], self.tokens[end - 1][3]) if b <= end - 1 < len(self.tokens) else None

    def _ended(self, words: frozenset[str]) -> Iterator[tuple[str, int, int]]:
        """Branches of a language whose blocks are closed by ``end``."""
        stack: list[tuple[str, int]] = []
        for i, (kind, t, start, end) in enumerate(self.tokens):
            if kind != "word":
                continue
            if t in words or t in ("proc", "export", "begin"):
                stack.append((t, start))
            elif t == "end" and stack and not self.is_(i - 1, "."):
                w, at = stack.pop()
                if w in words:
                    yield w, at, end

    # Functions: dictionaries with s and e (token indices), body (token index or None), name, kind.

    def functions(self) -> list[dict]:
        name = self.language.name
        if name == "masm":
            found = self._masm_functions()
        elif self.js:
            found = self._js_functions()
        elif name in ("cpp", "java"):
            found = self._headed_functions()
        else:
            found = self._keyword_functions()
        return sorted(found, key=lambda f: (f["s"], -f["e"]))

    def _keyword_functions(self) -> Iterator[dict]:
        name, n = self.language.name, len(self.tokens)
        for i, (kind, t, _, _) in enumerate(self.tokens):
            if kind != "word" or t not in self.language.function or self.is_(i - 1, "."):
                continue
            k, receiver = i + 1, None
            if name == "go" and self.is_(k, "("):
                if self.word(self.after(k)) is None or not self.is_(self._generic_end(self.after(k) + 1), "("):
                    continue
                receiver, k = k, self.after(k)
            if name == "solidity" and t in ("fallback", "receive"):
                if not self.is_(k, "(") or self.is_(i - 1, "function"):
                    continue
                label, params = t, k
            else:
                if name == "tolk" and t == "get" and (self.word(k) is None or self.is_(k, "fun")):
                    continue
                label = self.word(k)
                if label is None:
                    continue
                params = self._generic_end(k + 1)
                if not self.is_(params, "("):
                    continue
            body = self.after(params)
            while body < n and not self.is_(body, "{", ";") and not self.is_(body, "}"):
                if name == "go" and self.row(self.tokens[body][2]) > self.row(self.tokens[body - 1][3] - 1):
                    break
                if name == "go" and self.is_(body, "interface", "struct") and self.is_(body + 1, "{"):
                    body += 1  # a type in the result
                body = self.after(body)
            braced = self.is_(body, "{")
            if not braced and name in ("rust",):
                continue
            start = self._with_modifiers(i)
            end = self.pair.get(body, n - 1) if braced else body if self.is_(body, ";") else body - 1
            yield {"kind": t, "name": label, "s": start, "e": end, "body": body if braced else None, "params": params, "receiver": receiver}

    def _with_modifiers(self, i: int) -> int:
        name = self.language.name
        if name == "solidity" or name == "go":
            return i
        while i > 0:
            if self.word(i - 1) in ("pub", "async", "unsafe", "const", "extern", "public", "entry", "native", "inline", "export", "pure", "unconstrained", "friend", "macro"):
                i -= 1
            elif self.is_(i - 1, ")") and self.word(self.pair.get(i - 1, 0) - 1) in ("pub", "public"):
                i = self.pair[i - 1] - 1
            elif self.tokens[i - 1][0] == "string" and self.word(i - 2) == "extern":
                i -= 2
            else:
                return i
        return i

    def _generic_end(self, k: int) -> int:
        if self.is_(k, "[") and self.language.name == "go":
            return self.after(k)
        if not self.is_(k, "<"):
            return k
        depth = 0
        while k < len(self.tokens):
            if self.is_(k, "<"):
                depth += 1
            elif self.is_(k, ">"):
                depth -= 1
                if not depth:
                    return k + 1
            elif self.is_(k, ";", "{"):
                return k
            k = self.after(k)
        return k

    def _head_start(self, i: int) -> int:
        """The first token of the declaration that i is part of."""
        while i > 0 and not self.is_(i - 1, ";", "{", "}") and not (self.is_(i - 1, ":") and self.word(i - 2) in ("public", "private", "protected")):
            i = self.pair.get(i - 1, i - 1) if self.is_(i - 1, ")", "]") else i - 1
        return i

    def _headed_functions(self) -> Iterator[dict]:
        java, end, n = self.language.name == "java", -1, len(self.tokens)
        for i in range(1, n):
            if not self.is_(i, "("):
                continue
            operator = None if java else self._operator(i)
            at = i - 1 if operator is None else operator
            name = self.word(at)
            if name is None or operator is None and (name in _NOT_CALLS or java and name == "synchronized" or self.word(at - 1) == "record"):
                continue
            inside = self._in_type(i)
            if java and self.is_(at - 1, "{", "}", ";", ",") and name != self._type_name(self.brace[i]):
                continue  # without a type before it only a constructor is a function; others are constants of an enum
            if at <= end and not inside or java and not inside:  # within a function only members of types are functions
                continue
            k = self.after(i)
            while k < n and (self.word(k) in ("const", "noexcept", "override", "final", "throws", "volatile", "mutable") or self.is_(k, "->", "&", "&&") or (self.word(k) and (self.is_(k - 1, "throws", "->", "::", ",", ".")))) or self.is_(k, "::", ".") or (java and self.is_(k, ",")):
                k += 1
            if not java and self.is_(k, ":"):
                k += 1
                while k < n and not (self.is_(k, "{") and not self.tokens[k - 1][0] == "word") and not self.is_(k, ";"):
                    k = self.after(k)
            head = self._head_start(at)
            if not self._plain(head, at - 1):
                continue
            kind = "method" if java else "function"
            if operator is not None:
                name = "".join(self.text[self.tokens[operator][2] : self.tokens[i - 1][3]].split()) if not self.word(i - 1) or i - 1 == operator else " ".join(self.text[self.tokens[operator][2] : self.tokens[i - 1][3]].split())
            if self.is_(k, "{"):
                end = max(end, self.pair.get(k, n - 1))
                yield {"kind": kind, "name": name, "s": head, "e": self.pair.get(k, n - 1), "body": k, "params": i}
            elif java and self.is_(k, ";") and head < at and (self.word(at - 1) or self.is_(at - 1, ">", "]")):
                yield {"kind": kind, "name": name, "s": head, "e": k, "body": None, "params": i}
            elif not java and self.is_(k, "=") and self.word(k + 1) in ("default", "delete") and self.is_(k + 2, ";"):
                yield {"kind": kind, "name": name, "s": head, "e": k + 2, "body": None, "params": i}

    def _operator(self, i: int) -> int | None:
        """The word operator of the function whose parameters begin at i."""
        k = i - 1
        if self.is_(k, ")", "]") and self.pair.get(k) == k - 1:
            return k - 2 if self.is_(k - 2, "operator") else None
        while k >= max(0, i - 8) and not self.is_(k, ";", "{", "}", ",", *_OPEN, *_CLOSE):
            if self.is_(k, "operator"):
                return k if k < i - 1 else None
            k -= 1
        return None

    def _plain(self, head: int, k: int) -> bool:
        """No assignment, call chain or expression between the start of a declaration and the name of its function."""
        while k >= head:
            if self.is_(k, "=", "return", "new", "."):
                return False
            k = self.pair.get(k, k) - 1 if self.is_(k, *_CLOSE) else k - 1
        return True

    def _in_type(self, i: int) -> bool:
        """Whether the brace around i is that of a class, interface, enum or record, of an anonymous class or of a constant of an enum."""
        brace = self.brace[i]
        if brace not in self._types:
            self._types[brace] = self._of_type(brace)
        return self._types[brace]

    def _heads(self, brace: int, *words: str) -> int | None:
        """The token before the brace that is one of the words."""
        k = self._head_start(brace)
        while k < brace:
            if self.word(k) in words and not self.is_(k - 1, "."):
                return k
            k = self.after(k)
        return None

    def _type_name(self, brace: int) -> str | None:
        k = self._heads(brace, "class", "interface", "enum", "record") if brace >= 0 else None
        return None if k is None else self.word(k + 1)

    def _of_type(self, brace: int) -> bool:
        if self.js:  # a class or an object; other braces are blocks
            return self._heads(brace, "class") is not None or not (self.is_(brace - 1, ")", "=>", "else", "do", "try", "finally") or brace == 0)
        if self._heads(brace, "class", "interface", "enum", "record", "struct", "union") is not None:
            return True
        if self.language.name != "java":
            return False
        k = brace - 1
        if self.is_(k, ")"):
            k = self.pair.get(k, k) - 1
        around = self.brace[brace]
        if around >= 0 and self._heads(around, "enum") is not None and self.word(k) and not any(self.is_(x, ";") and self.brace[x] == around for x in range(around, brace)):
            return True
        if not self.is_(brace - 1, ")"):
            return False
        while k > 0 and (self.word(k) not in (None, "new") or self.is_(k, ".", "<", ">", ",", "?", "@")):
            k -= 1
        return self.is_(k, "new")

    def _js_functions(self) -> Iterator[dict]:
        n = len(self.tokens)
        for i, (kind, t, _, _) in enumerate(self.tokens):
            if kind == "word" and t == "function" and not self.is_(i - 1, "."):
                k = i + 1 + self.is_(i + 1, "*")
                label = self.word(k)
                params = self._generic_end(k + (label is not None))
                if self.is_(params, "("):
                    body = self._typed_body(self.after(params))
                    if self.is_(body, "{"):
                        yield {"kind": "function", "name": label, "s": i - self.is_(i - 1, "async"), "e": self.pair.get(body, n - 1), "body": body, "params": params}
            elif kind == "op" and t == "=>":
                a = i - 1
                if not self.is_(a, ")") and not (self.word(a) and not self.is_(a - 1, ":", "|", "&", "<", ".")):
                    while a > 0 and not self.is_(a, ")", ";", "{", "}", "=", ","):
                        a -= 1
                if self.is_(a, ")") and a in self.pair:
                    a = self.pair[a]
                elif not self.word(a):
                    continue
                if self.is_(a - 1, ":") and self.is_(a - 2, ")") or self.is_(i + 1, "void", "any") and not self.is_(i + 2, "{", "("):
                    continue
                a -= self.is_(a - 1, "async")
                if self.is_(i + 1, "{"):
                    end, body = self.pair.get(i + 1, n - 1), i + 1
                else:
                    end, body = self.plain_end(i + 1), i + 1
                    end -= self.is_(end, ";")
                if body < n:
                    yield {"kind": "arrow_function", "name": None, "s": a, "e": end, "body": body, "params": None}
            elif (first := self._member(i)) is not None:
                params = self._generic_end(i + 1)
                body = self._typed_body(self.after(params))
                if self.is_(body, "{"):
                    s = first
                    while self.word(s - 1) in _MODIFIERS or self.is_(s - 1, "*"):
                        s -= 1
                    name = self.text[self.tokens[first][2] : self.tokens[i][3]]
                    yield {"kind": "method", "name": name, "s": s, "e": self.pair.get(body, n - 1), "body": body, "params": params}

    def _member(self, i: int) -> int | None:
        """The first token of the name that ends at i, if a method may have it: a word, one behind a hash, a literal or an expression in brackets."""
        kind, t, _, _ = self.tokens[i]
        if not self.is_(self._generic_end(i + 1), "("):
            return None
        first = i
        if kind == "op":
            if t != "]" or i not in self.pair:
                return None
            first = self.pair[i]
        elif kind == "word":
            private = self.is_(i - 1, "#") and self.tokens[i - 1][3] == self.tokens[i][2]
            if t in _NOT_CALLS and t != "constructor" and not private:
                return None
            first -= private
        if first == 0 or not self._in_type(first) or not (self.is_(first - 1, "{", "}", ";", ",", "*") or self.word(first - 1) in _MODIFIERS):
            return None
        return first

    def _typed_body(self, k: int) -> int:
        if self.is_(k, ":"):
            k += 1
            if self.is_(k, "{"):
                k = self.after(k)
            while k < len(self.tokens) and not self.is_(k, "{", ";", "=>", "}", "="):
                k = self.after(k)
        return k

    def _masm_functions(self) -> Iterator[dict]:
        depth: list[tuple[str, int]] = []
        for i, (kind, t, _, _) in enumerate(self.tokens):
            if kind == "word" and t in ("proc", "export", "begin", "if", "while", "repeat"):
                depth.append((t, i))
            elif kind == "word" and t == "end" and depth and not self.is_(i - 1, "."):
                w, s = depth.pop()
                if w in ("proc", "export", "begin"):
                    dotted = self.is_(s + 1, ".")
                    label = "begin" if w == "begin" else self.word(s + 1 + dotted)
                    yield {"kind": "entrypoint" if w == "begin" else "procedure", "name": label, "s": s, "e": i, "body": None, "params": None}

    # Calls and literals.

    def calls(self, defined: set[int]) -> Iterator[tuple[int, int, int]]:
        """(first token, token of the name, closing parenthesis); the first takes in the receiver."""
        for i, (kind, t, _, _) in enumerate(self.tokens):
            if kind != "op" or t != "(" or i == 0 or i in defined or i not in self.pair:
                continue
            k = i - 1
            if self.language.name == "rust" and self.is_(k, ">"):
                depth = 0
                while k > 0:
                    depth += self.is_(k, ">") - self.is_(k, "<")
                    k -= 1
                    if not depth:
                        break
                k -= self.is_(k, "::")
            elif self.is_(k, "}") and self.language.name == "solidity":
                k = self.pair.get(k, k) - 1  # call options
            if self.is_(k, "!") and self.language.name == "rust":
                continue
            if self.word(k) is None or self.tokens[k][1] in _NOT_CALLS and not self.is_(k - 1, ".", "::") or self.is_(k - 1, "emit", "revert", "function", "modifier", "event", "error", "circuit"):
                continue
            yield self.receiver_start(k), k, self.pair[i]

    def receiver_start(self, k: int) -> int:
        """The first token of what the name k is called on. Links of a chain are asked for from left to right, so each takes one step."""
        name = k
        while self.is_(k - 1, ".", "::", "?."):
            k -= 2
            while k > 0 and self.is_(k, ")", "]") and k in self.pair:
                k = self.pair[k] - 1
                if not (self.tokens[k][0] == "word" or self.is_(k, ")", "]")):
                    self._starts[name] = k + 1
                    return k + 1
            if k in self._starts:
                k = self._starts[k]
                break
        self._starts[name] = max(k, 0)
        return self._starts[name]

    def literals(self) -> Iterator[tuple[str, int, int]]:
        for sign in self.language.literals:
            for i in range(1, len(self.tokens)):
                if not self.is_(i, sign) or i not in self.pair:
                    continue
                before = self.tokens[i - 1]
                if sign == "[":
                    if before[0] == "op" and before[1] not in (")", "]", "}", "#", "!") or self.is_(i - 1, "return", "in", "of"):
                        yield "array", i, self.pair[i]
                elif self.language.name == "go":
                    if before[0] == "word" and (self.is_(i - 2, "]", "=", ":", ",", "(", "&", "return", ".") or self.is_(i - 2, "[")) and not self.is_(i - 1, "struct", "interface", "else", "select", "for", "switch"):
                        yield "literal", i - 1, self.pair[i]
                elif before[0] == "op" and before[1] in ("=", "(", ",", "[", ":", "{", "?", "]") or self.is_(i - 1, "return"):
                    if not (self.js and before[1] == "{") and not (before[1] == "]" and self.language.name != "java"):
                        yield "literal", i, self.pair[i]


def _span(src: Source, s: int, e: int) -> dict:
    a, b = src.tokens[s][2], src.tokens[e][3]
    row = src.row(a)
    return {"start_idx": a, "end_idx": b, "start_row": row, "start_col": a - src.starts[row], "end_row": src.row(max(a, b - 1))}


def _depths(spans: list[tuple[int, int]]) -> list[int]:
    """For each (start, end), in the order of starts and of falling ends, how many strictly contain it; what is open is a stack, all of which contains a span that its top does."""
    out: list[int] = []
    stack: list[tuple[int, int]] = []
    proper = True  # as long as spans are nested or apart
    for start, end in spans:
        while stack and stack[-1][1] <= start:
            stack.pop()
        proper = proper and (not stack or stack[-1][1] >= end)
        if proper:
            same = 0
            while same < len(stack) and stack[-1 - same] == (start, end):
                same += 1
            out.append(len(stack) - same)
        else:
            out.append(sum(e >= end and (s, e) != (start, end) for s, e in stack))
        stack.append((start, end))
    return out


def _inner(spans: list[tuple[int, int, int | None]]) -> list[bool]:
    """For each (start, end, body), in that order, whether another strictly contains it; one with a body only what begins before that."""
    out: list[bool] = []
    stack: list[tuple[int, int, int]] = []
    for start, end, body in spans:
        while stack and stack[-1][1] <= start:
            stack.pop()
        out.append(any(e >= end and (s, e) != (start, end) and start < b for s, e, b in stack))  # the outermost, which comes first, mostly does
        stack.append((start, end, end + 1 if body is None else body))
    return out


def _comments(src: Source) -> Iterator[dict]:
    text, covered = src.text, -1
    for k, (a, b) in enumerate(src.comments):
        first, last = src.row(a), src.row(max(a, b - 1))
        own = range(max(first, covered + 1), last + 1)
        bare = sum(bool(_BARE.match(text, src.starts[r], src.starts[r + 1] if r + 1 < len(src.starts) else len(text))) for r in own)
        covered = max(covered, last)
        yield {"fact": "comment", "ord": k, "start_idx": a, "end_idx": b, "start_row": first, "end_row": last, "rows": len(own), "bare_rows": bare}


def _branches(src: Source) -> Iterator[dict]:
    branches = sorted(src.branches(), key=lambda x: (x[1], -x[2]))
    for k, ((kind, a, b), depth) in enumerate(zip(branches, _depths([(a, b) for _, a, b in branches]))):
        yield {"fact": "branch", "ord": k, "kind": kind, "start_idx": a, "end_idx": b, "start_row": src.row(a), "end_row": src.row(max(a, b - 1)), "depth": depth}


def scan(path: str, language: str | Language, text: str, only: frozenset[str] = ALL) -> Iterator[dict]:
    """The facts of a file: comment, branch, norm, function, container, call; or ``only`` some of them."""
    language = REGISTRY[language] if isinstance(language, str) else language
    src, name = Source(text, language), language.name
    if "comment" in only:
        yield from _comments(src)
    if "branch" in only:
        yield from _branches(src)
    if only.isdisjoint(("norm", "function", "container", "call")):
        return
    functions = src.functions()
    containers = [] if only.isdisjoint(("function", "container")) else list(_containers(src))
    defined = {f["params"] for f in functions if f.get("params") is not None}
    norms: list[dict] = []
    for k, f in enumerate(functions):
        span = _span(src, f["s"], f["e"])
        body = f["body"]
        body_idx = src.tokens[body][2] if body is not None else None
        span |= {"body_idx": body_idx, "body_row": None if body_idx is None else src.row(body_idx), "name": f["name"], "kind": f["kind"]}
        f["ord"] = k
        if "function" in only:
            raw = text[span["start_idx"] : span["end_idx"] if body_idx is None else body_idx]
            owner = [c for c in containers if c["body"] is not None and c["body"] < f["s"] and f["e"] <= c["e"]]
            inner = max(owner, key=lambda c: c["body"], default=None)
            yield span | {"fact": "function", "ord": k, "text": raw, "owner": inner and inner["name"], "owner_kind": inner and inner["kind"], "names": _params(src, f), "libs": [_visibility(src, f), _receiver(src, f), *_reach(src, f, owner)]}
        like = language.functionlike and body_idx is not None
        norms.append(span | {"fact": "norm", "ord": k, "kind": "function", "name": f["name"], "body_idx": body_idx if like else None, "body_row": span["body_row"] if like else None})
    calls = list(src.calls(defined)) if name != "masm" and not only.isdisjoint(("norm", "call")) else []
    if "norm" in only:
        norms += [_span(src, s, e) | {"fact": "norm", "ord": 10_000_000 + k, "kind": "call"} for k, (s, _, e) in enumerate(calls)]
        norms += [_span(src, s, e) | {"fact": "norm", "ord": 20_000_000 + k, "kind": kind} for k, (kind, s, e) in enumerate(src.literals())]
        norms.sort(key=lambda x: (x["start_idx"], -x["end_idx"]))
        for x, inner in zip(norms, _inner([(x["start_idx"], x["end_idx"], x.get("body_idx")) for x in norms])):
            yield x | {"depth": int(inner)}
    if "container" in only:
        for k, c in enumerate(containers):
            yield _span(src, c["s"], c["e"]) | {"fact": "container", "ord": k, "kind": c["kind"], "name": c["name"], "names": c["parents"], "libs": c["libs"]}
    if "call" in only and name in ("solidity", "rust", "go"):
        yield from _call_sites(src, functions, calls)


def _containers(src: Source) -> Iterator[dict]:
    name = src.language.name
    for i in range(len(src.tokens)):
        w = src.word(i)
        if name == "solidity" and w in ("contract", "interface", "library") and src.word(i + 1):
            body = src.block_start(i + 1)
            if not src.is_(body, "{"):
                continue
            end, parents, k = src.pair.get(body, len(src.tokens) - 1), [], i + 2
            if src.is_(k, "is"):
                k += 1
                while k < body:
                    first = k
                    while src.is_(k + 1, "."):
                        k += 2
                    parents.append(src.text[src.tokens[first][2] : src.tokens[k][3]])
                    k += 1
                    while k < body and not src.is_(k - 1, ","):
                        k = src.after(k)
            libs = []
            for u in range(body, end):
                if src.is_(u, "using") and src.word(u + 1):
                    k = u + 1
                    while src.is_(k + 1, "."):
                        k += 2
                    libs.append(src.text[src.tokens[u + 1][2] : src.tokens[k][3]])
            yield {"kind": w, "name": src.word(i + 1), "s": i, "e": end, "body": body, "parents": parents, "libs": libs}
        elif name == "rust" and w in ("impl", "mod", "trait") and not src.is_(i - 1, "->", ":", "(", ",", "&", "<"):
            body = i + 1
            while body < len(src.tokens) and not src.is_(body, "{", ";"):
                body += 1
            if not src.is_(body, "{"):
                continue
            label = src.word(i + 1)
            if w == "impl":
                k = src._generic_end(i + 1)
                target = k
                for x in range(k, body):
                    if src.is_(x, "for"):
                        target = x + 1
                    if src.is_(x, "where"):
                        break
                while target < body and (src.is_(target, "&", "mut", "dyn") or src.tokens[target][0] != "word"):
                    target += 1
                while src.is_(target + 1, "::"):
                    target += 2
                label = src.word(target)
            if label:
                yield {"kind": w, "name": label, "s": i, "e": src.pair.get(body, len(src.tokens) - 1), "body": body, "parents": [], "libs": []}


def _params(src: Source, f: dict) -> list[str] | None:
    """The full texts of the parameters."""
    if f.get("params") is None or f["params"] not in src.pair:
        return None
    out, a, k, end = [], f["params"] + 1, f["params"] + 1, src.pair[f["params"]]
    while k <= end:
        if k == end or src.is_(k, ","):
            if k > a:
                out.append(" ".join(src.text[src.tokens[a][2] : src.tokens[k - 1][3]].split()))
            a = k + 1
        k = k + 1 if k == end else src.after(k)
    return out


def _visibility(src: Source, f: dict) -> str | None:
    """The token that says how visible a function is, before it in Rust, between parameters and body in Solidity."""
    name = src.language.name
    if name == "rust":
        head = [src.tokens[k][1] for k in range(f["s"], f["params"] or f["s"])]
        if "pub" not in head:
            return None
        k = f["s"] + head.index("pub")
        return "pub" if not src.is_(k + 1, "(") else "pub(" + (src.word(k + 2) or "") + ")"
    if name == "solidity" and f["params"] in src.pair:
        stop = f["body"] if f["body"] is not None else f["e"]
        for k in range(src.pair[f["params"]] + 1, stop):
            if src.word(k) in ("external", "public", "internal", "private"):
                return src.word(k)
            if src.is_(k, "returns"):
                break
    return None


def _receiver(src: Source, f: dict) -> str | None:
    r = f.get("receiver")
    return None if r is None else src.text[src.tokens[r][2] : src.tokens[src.pair[r]][3]]


def _reach(src: Source, f: dict, owner: list[dict]) -> list[str | None]:
    """Whether a function is free, the name of the innermost implementation around it, that of the module of the file around it."""
    free = "free" if src.depth[f["s"]] == 0 else None
    inner = max((c for c in owner if c["kind"] == "impl"), key=lambda c: c["body"], default=None)
    module = next((c["name"] for c in owner if c["kind"] == "mod" and src.depth[c["s"]] == 0), None)
    return [free, inner and inner["name"], module]


def _call_sites(src: Source, functions: list[dict], calls: list[tuple[int, int, int]]) -> Iterator[dict]:
    """Calls within each function, those of nested ones and of builtins as well: kind, name, receiver in ``owner``."""
    name = src.language.name
    assembly, macros = bytearray(len(src.tokens)), bytearray(len(src.tokens))
    if name == "solidity":
        for i in range(len(src.tokens)):
            if src.is_(i, "assembly"):
                body = src.block_start(i + 1)
                end = src.pair.get(body, len(src.tokens) - 1)
                assembly[body:end] = b"\1" * max(0, end - body)
    if name == "rust":
        for i in range(1, len(src.tokens) - 1):
            if src.is_(i, "!") and src.word(i - 1) and src.is_(i + 1, *_OPEN) and i + 1 in src.pair:
                macros[i : src.pair[i + 1]] = b"\1" * (src.pair[i + 1] - i)
    places = [k for _, k, _ in calls]
    rank = {"super": 0, "member": 1, "method": 1, "selector": 1, "this": 2, "scoped": 2, "simple": 3, "assembly": 4}
    if name == "rust":
        rank = {"simple": 0, "method": 1, "scoped": 2, "generic_simple": 3, "generic_scoped": 4}
    if name == "go":
        rank = {"simple": 0, "selector": 1}
    for f in functions:
        rows = []
        for s, k, _ in calls[bisect_right(places, f["s"]) : bisect_right(places, f["e"])]:
            if macros[k]:
                continue
            label = src.tokens[k][1]
            yul = assembly[k]
            receiver = src.text[src.tokens[s][2] : src.tokens[k - 2][3]] if k >= 2 and k > s and src.is_(k - 1, ".", "::") else None
            generic = name == "rust" and src.is_(k + 1, "::")
            if name == "solidity":
                if yul:
                    kinds = ["assembly"]
                elif receiver == "super":
                    kinds = ["super"]
                elif receiver == "this":
                    kinds = ["member", "this"]
                else:
                    kinds = ["member"] if receiver is not None else ["simple"]
            elif name == "go":
                kinds = ["selector"] if receiver is not None else ["simple"]
            elif receiver is None:
                kinds = ["generic_simple" if generic else "simple"]
            elif src.is_(k - 1, "."):
                kinds = ["method"]
            else:
                kinds = ["generic_scoped" if generic else "scoped"]
            rows += [(rank[c], k, c, label, receiver) for c in kinds]
        for n, (_, k, kind, label, receiver) in enumerate(sorted(rows, key=lambda r: r[:2])):
            yield {"fact": "call", "ord": n, "kind": kind, "name": label, "owner": receiver, "start_idx": src.tokens[k][2], "fn_ord": f["ord"]}


def spread(files: DataFrame) -> DataFrame:
    """``files`` dealt by their paths to as many tasks as any shuffle of the session has, fewer if Spark takes them for few: scans take long for their bytes, and a table of many files may lie in one partition."""
    spark = files.sparkSession
    least, most = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return files.repartition(max(least, min(most, size // _SPREAD_BYTES)), "path")


def scan_files(files: DataFrame, only: Iterable[str] = ALL) -> DataFrame:
    """``FACTS`` of ``files`` (path, language, content) in the languages that are registered now; or ``only`` some of them.

    A file that can't be scanned has one fact, error, with the message as its text; a null content has none. Facts of many files share a batch.
    """
    languages = dict(REGISTRY)  # goes to the executors, whose own registry knows nothing of what was registered here
    only = frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r.get(n) for r in rows], f.type) for n, f in zip(_NAMES, _SCHEMA)], schema=_SCHEMA)

        for given in batches:
            for path, language, content in zip(*(c.to_pylist() for c in given.columns)):
                if content is None:
                    continue
                about = {"path": path, "language": language}
                try:
                    found = [about | r for r in scan(path, languages[language], content, only)]
                except Exception as problem:  # noqa: BLE001
                    found = [about | {"fact": "error", "ord": 0, "text": f"{type(problem).__name__}: {problem}"}]
                for r in found:
                    rows.append(r)
                    size += len(r.get("text") or "")
                    if len(rows) >= _BATCH_ROWS or size >= _BATCH_TEXT:
                        yield batch()
                        rows.clear()
                        size = 0
        if rows:
            yield batch()

    return spread(files.select("path", "language", "content").where("language is not null")).mapInArrow(run, FACTS)


# What is asked of each file for itself: a row for each, so nothing is gathered by path afterwards.


def _by_file(files: DataFrame, of: Callable[..., tuple | None], columns: str) -> DataFrame:
    """``columns`` that ``of`` returns for the language, content and further columns of each file, behind its path and language; files for which it returns None have no row."""
    languages = dict(REGISTRY)
    schema = pa.schema([(n, _KIND[t]) for n, t in (x.split() for x in f"path string, language string, {columns}".split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            rows = []
            for values in zip(*given.columns):  # one text at a time is made a string
                path, language, *more = (v.as_py() for v in values)
                found = of(languages[language], *more)
                if found is not None:
                    rows.append((path, language, *found))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(run, f"path string, language string, {columns}")


def _blank(line: str) -> bool:
    """As ``functions.expressions.is_blank``, whose end may be before a last U+0085."""
    return line.lstrip(_WHITE) in ("", "\x85")


def _measured(language: Language, text: str) -> tuple | None:
    lines = text.split("\n")
    comments = bare = complexity = excess = 0
    try:
        for x in scan("", language, text, frozenset(("comment", "branch", "norm"))):
            if x["fact"] == "comment":
                comments, bare = comments + x["rows"], bare + x["bare_rows"]
            elif x["fact"] == "branch":
                complexity += x["depth"] + 1
            elif not x["depth"]:
                body = x.get("body_row")
                excess += max(0, (x["end_row"] if body is None else body - 1) - x["start_row"])
    except Exception:  # noqa: BLE001
        return None
    return len(lines), sum(map(_blank, lines)), comments, bare, complexity, excess


def measure_files(files: DataFrame) -> DataFrame:
    """(path, language, total_lines, blank_lines, lines_with_comments, comment_only, complexity, adjustment) of each file that has content and can be scanned: what ``operators.metrics`` makes of its lines and facts."""
    known = files.where("language is not null and content is not null").select("path", "language", "content")
    return _by_file(spread(known), _measured, "total_lines long, blank_lines long, lines_with_comments long, comment_only long, complexity long, adjustment long")


def _texts(language: Language, text: str) -> tuple | None:
    try:
        found = [x["text"] for x in scan("", language, text, frozenset(("function",)))]
    except Exception:  # noqa: BLE001
        return None
    return (found,) if found else None


def function_texts(files: DataFrame) -> DataFrame:
    """(path, language, texts) of each file that has functions: what stands before their bodies, in the order of the source."""
    known = files.where("language is not null and content is not null").select("path", "language", "content")
    return _by_file(spread(known), _texts, "texts array<string>")


def _changed(language: Language, text: str | None, added: list[int] | None, *given: object) -> tuple:
    if text is None:
        return (*given, 0, 0, 0)
    lines, spans = text.split("\n"), {"comment": ([], []), "branch": ([], [])}
    try:
        for x in scan("", language, text, frozenset(spans)):
            spans[x["fact"]][0].append(x["start_row"])
            spans[x["fact"]][1].append(x["end_row"])
    except Exception:  # noqa: BLE001
        spans = {k: ([], []) for k in spans}
    for starts, ends in spans.values():
        starts.sort()
        ends.sort()
    around = lambda fact, row: bisect_right(spans[fact][0], row) - bisect_left(spans[fact][1], row)
    code = depth = comments = 0
    for i in added or ():
        if i is None or not 1 <= i <= len(lines) or _blank(line := lines[i - 1]):
            continue
        if i < len(lines) and line.lstrip(_WHITE).startswith(_CHANGED_BARE) and around("comment", i - 1):
            comments += 1
        else:
            code, depth = code + 1, depth + around("branch", i - 1)
    return (*given, code, depth, comments)


def measure_changes(files: DataFrame) -> DataFrame:
    """``files`` (path, language, content, added, status, added_lines, removed_lines) without the content and the list of lines added, but the numbers among these of those with code, ``n``, of branches around them, ``d``, and of those with comments alone, ``c``; 0 without content."""
    known = files.where("language is not null").select("path", "language", "content", "added", "status", "added_lines", "removed_lines")
    return _by_file(known, _changed, "status string, added_lines long, removed_lines long, n long, d long, c long")
