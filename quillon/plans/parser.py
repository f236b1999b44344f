"""Recursive-descent parser: SQL text of any dialect to a syntax tree."""

from __future__ import annotations

from typing import Any

from . import ast as A
from .dialects import Dialect, dialect
from .lexer import SqlError, Token, tokens

# Words that end an expression or a table and so can't be a bare alias.
STOP = set(
    "FROM WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH UNION INTERSECT EXCEPT MINUS ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL OUTER WINDOW QUALIFY PREWHERE AND OR XOR NOT IN IS LIKE ILIKE RLIKE REGEXP "
    "SIMILAR BETWEEN THEN ELSE END WHEN AS ASC DESC NULLS SET VALUES LATERAL STRAIGHT_JOIN START CONNECT FOR LOCK SELECT WITH RETURNING OVERLAPS SEMI ANTI ASOF GLOBAL TABLESAMPLE SAMPLE PIVOT UNPIVOT INTO DIV MOD COLLATE "
    "ISNULL NOTNULL ESCAPE SEPARATOR KEEP OVER FILTER WITHIN CLUSTER DISTRIBUTE SORT SETTINGS OPTION EMIT UNPIVOT MEMBER DO MATCHED PREFERRING MATCH_RECOGNIZE VERSIONS SEARCH CYCLE".split()
)
UNITS = set("MICROSECOND MILLISECOND SECOND MINUTE HOUR DAY WEEK MONTH QUARTER YEAR SECONDS MINUTES HOURS DAYS WEEKS MONTHS QUARTERS YEARS".split())
#: What goes on with an expression behind an operand.
BINDS = set("= <> != < > <= >= <=> *= =* ~ ~* !~ !~* @> <@ ? ?| ?& && || & | ^ << >> + - * / % DIV MOD AND OR XOR NOT IS ISNULL NOTNULL OVERLAPS MEMBER GLOBAL LIKE ILIKE RLIKE REGEXP SIMILAR BETWEEN IN".split())
COMPARE = {"=", "<>", "!=", "<", ">", "<=", ">=", "<=>"}


class Parser:
    def __init__(self, sql: str, d: str | Dialect = "ansi"):
        self.sql, self.d = sql, dialect(d)
        self.toks, self.comments = tokens(sql, self.d)
        self.last = len(self.toks) - 1
        self.i = 0

    # --- cursor

    @property
    def t(self) -> Token:
        return self.toks[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.toks[min(self.i + k, self.last)]

    def at(self, word: str, *more: str) -> bool:
        if self.toks[self.i].upper != word:
            return False
        for k, w in enumerate(more, self.i + 1):
            if k > self.last or self.toks[k].upper != w:
                return False
        return True

    def eat(self, *words: str) -> bool:
        if self.toks[self.i].upper == words[0] and (len(words) == 1 or self.at(*words)):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.eat(*words):
            raise SqlError(f"expected {' '.join(words)} at {self.t.at}, found {self.t.text or 'the end'!r}")

    def one_of(self, *words: str) -> str:
        if self.t.upper in words:
            self.i += 1
            return self.toks[self.i - 1].upper
        return ""

    def name(self) -> str:
        if self.t.kind not in ("word", "name"):
            raise SqlError(f"expected a name at {self.t.at}, found {self.t.text or 'the end'!r}")
        self.i += 1
        return self.toks[self.i - 1].text

    def names(self) -> list[str]:
        out = [self.name()]
        while self.eat("."):
            out.append(self.name())
        return out

    def listed(self, item) -> list[Any]:
        out = [item()]
        while self.eat(","):
            out.append(item())
        return out

    def in_parens(self, item) -> Any:
        self.need("(")
        out = item()
        self.need(")")
        return out

    def raw_parens(self) -> str:
        self.need("(")
        start, depth = self.t.at, 1
        while depth:
            if self.t.kind == "end":
                raise SqlError("a parenthesis isn't closed")
            depth += (self.t.text == "(") - (self.t.text == ")") if self.t.kind == "op" else 0
            self.i += 1
        return self.sql[start : self.toks[self.i - 1].at].strip()

    def value(self) -> str:
        """The text of a string or a word."""
        if self.t.kind not in ("string", "word", "name", "number"):
            raise SqlError(f"expected a value at {self.t.at}, found {self.t.text or 'the end'!r}")
        self.i += 1
        return self.toks[self.i - 1].text

    # --- queries

    def query(self) -> A.Select:
        ctes, recursive = [], False
        if self.eat("WITH"):
            recursive = self.eat("RECURSIVE")
            ctes = self.listed(self.cte)
        out = self.set_chain()
        out.ctes, out.recursive = ctes + out.ctes, recursive or out.recursive
        return out

    def cte(self) -> A.Cte:
        name = self.name()
        cols = self.in_parens(lambda: self.listed(self.name)) if self.at("(") else []
        self.need("AS")
        self.eat("NOT") and self.need("MATERIALIZED") or self.eat("MATERIALIZED")
        out = A.Cte(name, cols, self.in_parens(self.query))
        if self.eat("SEARCH"):
            kind = self.one_of("DEPTH", "BREADTH")
            self.need("FIRST", "BY")
            keys = self.listed(self.name)
            self.need("SET")
            out.search = (kind, keys, self.name())
        if self.eat("CYCLE"):
            keys = self.listed(self.name)
            self.need("SET")
            flag = self.name()
            if self.eat("TO"):
                self.value()
                self.need("DEFAULT")
                self.value()
            out.cycle = (keys, flag, self.name() if self.eat("USING") else "")
        return out

    def arm(self) -> A.Select:
        if self.eat("("):
            out = self.query()
            self.need(")")
            out.nested = True
            return out
        if self.eat("VALUES"):
            return A.Select(rows=self.listed(lambda: A.Row(self.in_parens(lambda: self.listed(self.expr)))))
        if self.at("TABLE") and self.peek().kind in ("word", "name"):
            self.i += 1
            return A.Select(items=[A.Star()], source=A.Table(self.names()))
        return self.select()

    def set_chain(self) -> A.Select:
        first = self.arm()
        sets = []
        while op := self.one_of("UNION", "INTERSECT", "EXCEPT", "MINUS"):
            op = "EXCEPT" if op == "MINUS" else op
            op += " ALL" if self.eat("ALL") else ""
            self.eat("DISTINCT")
            sets.append((op, self.arm()))
        if not sets and first.nested and self.t.upper in ("ORDER", "LIMIT", "OFFSET", "FETCH"):
            first = A.Select(items=[A.Star()], source=A.Derived(first, "q"))
        if sets and (first.sets or first.order or first.limit or first.ctes):
            first = A.Select(items=[A.Star()], source=A.Derived(first, "q"))
        first.sets = first.sets + sets if sets else first.sets
        self.tail(first)
        return first

    def tail(self, q: A.Select) -> None:
        while True:
            if self.eat("ORDER", "SIBLINGS", "BY"):
                q.order, q.siblings = self.listed(self.key), True
            elif self.eat("ORDER", "BY"):
                q.order = self.listed(self.key)
            elif self.eat("LIMIT"):
                if self.eat("ALL"):
                    continue
                n = self.bits()
                if self.eat(","):
                    q.offset, n = n, self.bits()
                if self.eat("BY"):
                    q.limit_by = (n, self.listed(self.expr))
                    continue
                q.limit = n
                q.percent = bool(self.eat("PERCENT"))
                if self.eat("WITH", "TIES"):
                    q.ties = True
            elif self.eat("OFFSET"):
                q.offset = self.bits()
                self.one_of("ROW", "ROWS")
            elif self.eat("FETCH"):
                self.one_of("FIRST", "NEXT")
                q.limit = A.Lit("number", "1") if self.t.upper in ("ROW", "ROWS") else self.bits()
                q.percent = self.eat("PERCENT")
                self.one_of("ROW", "ROWS")
                q.ties = self.eat("WITH", "TIES") or (self.eat("ONLY") and False)
            elif self.at("FOR") and self.peek().upper in ("UPDATE", "SHARE"):
                q.locked, self.i = True, self.i + 2
                self.eat("NOWAIT") or self.eat("SKIP", "LOCKED")
            elif self.at("FOR", "JSON") or self.at("FOR", "XML"):
                q.shape, self.i = self.peek().upper, self.i + 2
                while self.t.kind != "end" and self.t.text not in (")", ";"):
                    self.i += 1
            elif self.eat("LOCK", "IN", "SHARE", "MODE"):
                q.locked = True
            elif self.eat("WITH", "UR") or self.eat("EMIT", "CHANGES"):
                pass
            elif self.eat("OPTION"):
                self.raw_parens()
            elif self.eat("SETTINGS"):
                while self.t.kind not in ("end",) and self.t.text not in (")", ";"):
                    self.i += 1
            else:
                return

    def key(self) -> A.Key:
        out = A.Key(self.expr())
        out.desc = self.one_of("ASC", "DESC") == "DESC"
        if self.eat("NULLS"):
            out.nulls = self.one_of("FIRST", "LAST")
        return out

    def select(self) -> A.Select:
        q = A.Select()
        self.need("SELECT")
        while self.t.kind == "hint":
            q.hints, self.i = self.t.text, self.i + 1
        if self.eat("SKIP"):
            q.offset = self.primary()
            if self.eat("FIRST"):
                q.limit = self.primary()
        if self.at("TOP") and self.peek().kind in ("number", "op", "param") and self.peek().text not in (",", "."):
            self.i += 1
            q.limit = self.primary()
            q.percent = self.eat("PERCENT")
            q.ties = self.eat("WITH", "TIES")
        if self.one_of("DISTINCT", "DISTINCTROW", "UNIQUE"):
            q.distinct = True
            if self.eat("ON"):
                q.distinct, q.distinct_on = False, self.in_parens(lambda: self.listed(self.expr))
        else:
            self.eat("ALL")
        if self.at("TOP") and self.peek().kind == "number":
            self.i += 1
            q.limit = self.primary()
        q.items = self.listed(self.item)
        if self.eat("INTO"):
            if self.one_of("OUTFILE", "DUMPFILE"):
                q.into, self.i = f"OUTFILE {self.t.text}", self.i + 1
            else:
                q.into = self.t.text if self.t.kind == "param" else ".".join(self.names())
                self.i += self.t.kind == "param"
        if self.eat("FROM"):
            q.source = self.sources()
        while True:
            if self.eat("WHERE") or self.eat("PREWHERE"):
                q.where = _and(q.where, self.expr())
            elif self.eat("START", "WITH"):
                q.start = self.expr()
            elif self.eat("CONNECT", "BY"):
                q.nocycle = self.eat("NOCYCLE")
                q.connect = self.expr()
            elif self.eat("GROUP", "BY"):
                self.group(q)
            elif self.eat("HAVING"):
                q.having = self.expr()
            elif self.eat("QUALIFY"):
                q.qualify = self.expr()
            elif self.eat("PREFERRING"):
                while side := self.one_of("HIGH", "LOW"):
                    q.preferring.append((side, self.bits()))
                    self.eat("PLUS") or self.eat("PRIOR", "TO")
            elif self.eat("WINDOW"):
                for name, w in self.listed(lambda: (self.name(), (self.need("AS"), self.in_parens(self.window))[1])):
                    q.windows[name] = w
            else:
                return q

    def group(self, q: A.Select) -> None:
        q.distinct_sets = self.eat("DISTINCT")
        self.eat("ALL")
        if self.at("(", ")"):
            self.i += 2
            q.grouping = "ALL"
            return

        def one():
            if self.at("GROUPING", "SETS") or self.at("ROLLUP", "(") or self.at("CUBE", "("):
                word = "GROUPING SETS" if self.eat("GROUPING", "SETS") else self.name().upper()
                self.need("(")
                sets = []
                while not self.eat(")"):
                    if self.at("(", ")"):
                        self.i += 2
                        sets.append(A.Row([]))
                    else:
                        sets.append(self.expr())
                    self.eat(",")
                return A.Call(word, sets)
            out = self.expr()
            self.one_of("ASC", "DESC")
            return out

        q.group = self.listed(one)
        if self.at("WITH") and self.peek().upper in ("ROLLUP", "CUBE"):
            q.grouping, self.i = self.peek().upper, self.i + 2

    def item(self) -> Any:
        star = self.star()
        if star:
            return star
        if self.t.kind in ("word", "name") and self.peek().text == "=" and self.d.name == "sqlserver":
            alias = self.name()
            self.i += 1
            return A.Column(self.expr(), alias)
        value = self.expr()
        return A.Column(value, self.alias())

    def star(self) -> A.Star | None:
        k = 0
        while self.peek(k).kind in ("word", "name") and self.peek(k + 1).text == ".":
            k += 2
        if self.peek(k).text != "*" or self.peek(k).kind != "op":
            return None
        out = A.Star([self.peek(j).text for j in range(0, k, 2)])
        self.i += k + 1
        while True:
            if self.t.upper in ("EXCEPT", "EXCLUDE") and (self.peek().text == "(" and self.peek(2).upper != "SELECT" or self.t.upper == "EXCLUDE"):
                self.i += 1
                out.excluded = self.in_parens(lambda: self.listed(self.name)) if self.at("(") else [self.name()]
            elif self.at("REPLACE", "("):
                self.i += 1
                out.replaced = self.in_parens(lambda: self.listed(lambda: (self.expr(), (self.need("AS"), self.name())[1])))
            else:
                return out

    def alias(self) -> str:
        if self.eat("AS"):
            if self.t.kind == "string":
                self.i += 1
                return self.toks[self.i - 1].text
            return self.name()
        if self.t.kind == "name" or self.t.kind == "word" and self.t.upper not in STOP:
            return self.name()
        return ""

    # --- sources

    def sources(self) -> Any:
        out = self.joined()
        while self.eat(","):
            if self.eat("OUTER"):  # FROM a, OUTER b
                out = A.Join("LEFT", out, self.joined())
            else:
                out = A.Join("CROSS", out, self.joined())
        return out

    def joined(self) -> Any:
        left = self.table()
        pending: list[A.Join] = []
        while True:
            start = self.i
            glob = self.eat("GLOBAL")
            natural = self.eat("NATURAL")
            if self.eat("STRAIGHT_JOIN"):
                kind = "INNER"
            elif self.at("CROSS", "APPLY") or self.at("OUTER", "APPLY"):
                kind = f"{self.t.upper} APPLY"
                self.i += 2
            else:
                kind = self.one_of("INNER", "LEFT", "RIGHT", "FULL", "CROSS")
                kind2 = self.one_of("OUTER", "SEMI", "ANTI")
                hint = self.one_of("HASH", "MERGE", "LOOP")
                if not self.eat("JOIN"):
                    self.i = start
                    break
                kind = f"{kind or ('LEFT' if kind2 else 'INNER')} {kind2}" if kind2 in ("SEMI", "ANTI") else kind or ("LEFT" if kind2 else "INNER")
                right = self.table()
                j = A.Join(kind, left, right, natural=natural, hint=hint or ("BROADCAST" if glob else ""))
                if self.eat("ON"):
                    j.on = self.expr()
                    while pending and self.eat("ON"):  # a JOIN b JOIN c ON … ON …
                        outer = pending.pop()
                        j = A.Join(outer.kind, outer.left, A.Join(j.kind, outer.right, j.right, j.on), self.expr())
                elif self.eat("USING"):
                    j.using = self.in_parens(lambda: self.listed(self.name))
                elif self.t.upper in ("JOIN", "INNER", "LEFT", "RIGHT") and kind not in ("CROSS",) and not natural:
                    pending.append(j)
                left = j
                continue
            left = A.Join(kind, left, self.table(), self.expr() if self.eat("ON") else None)
        return left

    def table(self) -> Any:
        if self.t.text == "{" and self.peek().upper == "OJ":
            self.i += 2
            out = self.joined()
            self.need("}")
            return out
        lateral = self.eat("LATERAL")
        if lateral and self.eat("VIEW"):
            raise SqlError("LATERAL VIEW without a table")
        if self.at("("):
            inner = self.peek()
            k = 1
            while self.peek(k).text == "(":
                k += 1
            if self.peek(k).upper in ("SELECT", "WITH", "VALUES") or inner.upper == "TABLE":
                out: Any = A.Derived(self.in_parens(self.query), lateral=lateral)
                if out.query.rows is not None and not out.query.sets:
                    out = A.Values(out.query.rows)
                self.eat("AS")
                out.alias = self.alias()
                if out.alias and self.at("("):
                    out.columns = self.in_parens(lambda: self.listed(self.name))
            else:
                out = self.in_parens(self.sources)
            return self.after_table(out)
        if self.eat("VALUES"):
            out = A.Values(self.listed(lambda: A.Row(self.in_parens(lambda: self.listed(self.expr)))))
            out.alias = self.alias()
            if out.alias and self.at("("):
                out.columns = self.in_parens(lambda: self.listed(self.name))
            return out
        if self.at("JSON_TABLE", "(") or self.at("OPENJSON", "("):
            return self.json_rows(self.at("JSON_TABLE"))
        if self.at("TABLE", "("):
            self.i += 1
            self.need("(")
            call = self.expr()
            self.need(")")
            return self.after_table(self.called(call, lateral))
        if self.at("UNNEST", "(") or self.peek().text == "(" and self.t.kind == "word":
            return self.after_table(self.called(self.primary(), lateral))
        out = A.Table(self.names())
        if self.at("PARTITION", "("):
            self.i += 1
            out.partition = self.in_parens(lambda: self.listed(self.partition))
        elif self.eat("FORCE", "PARTITION"):
            out.partition = [self.value()]
        self.travel(out)
        if self.eat("TABLESAMPLE") or self.eat("SAMPLE"):
            self.one_of("SYSTEM", "BERNOULLI", "BLOCK")
            percent = self.raw_parens().split()[0]
            seed = self.raw_parens() if self.one_of("REPEATABLE", "SEED") else ""
            out.sample = (percent, seed)
        if self.at("FINAL"):
            self.i += 1
        out.alias = self.alias()
        self.travel(out)
        while self.t.upper in ("USE", "FORCE", "IGNORE") and self.peek().upper in ("INDEX", "KEY"):
            self.i += 2
            self.raw_parens()
        if self.at("WITH", "("):
            self.i += 1
            self.raw_parens()
        return self.after_table(out)

    def partition(self) -> Any:
        name = self.value()
        return (name, self.expr()) if self.eat("=") else name

    def travel(self, out: A.Table) -> None:
        """FOR SYSTEM_TIME AS OF x, AS OF TIMESTAMP x, TIMESTAMP AS OF x, AS OF SCN n, VERSION AS OF n."""
        if self.eat("FOR", "SYSTEM_TIME", "AS", "OF") or self.eat("FOR", "TIMESTAMP", "AS", "OF") or self.eat("AS", "OF", "TIMESTAMP") or self.eat("TIMESTAMP", "AS", "OF"):
            out.travel = ("TIMESTAMP", self.bits())
        elif self.eat("FOR", "VERSION", "AS", "OF") or self.eat("AS", "OF", "SCN") or self.eat("VERSION", "AS", "OF"):
            out.travel = ("VERSION", self.bits())
        elif self.at("FOR", "SYSTEM_TIME") or self.at("VERSIONS", "BETWEEN"):
            raise SqlError("ranges of versions need a table format that keeps them as rows")

    def json_rows(self, table: bool) -> A.JsonRows:
        """JSON_TABLE(x, path COLUMNS (…)) and OPENJSON(x [, path]) WITH (…)."""
        self.i += 1
        self.need("(")
        value, path = self.expr(), "$"
        if self.eat(","):
            path = self.value()

        def one() -> tuple[str, str, str]:
            name = self.name()
            if self.eat("FOR", "ORDINALITY"):
                return name, "ORDINALITY", ""
            kind = self.type()
            at = self.value() if self.eat("PATH") or self.t.kind == "string" else f"$.{name}"
            while self.t.kind != "end" and self.t.text not in (",", ")"):  # ON EMPTY, ON ERROR, AS JSON: null and text as they are
                self.i += 1
            return name, kind, at

        if table:
            self.need("COLUMNS")
            fields = self.in_parens(lambda: self.listed(one))
            self.need(")")
        else:
            self.need(")")
            self.need("WITH")
            fields = self.in_parens(lambda: self.listed(one))
        return A.JsonRows(value, path, fields, self.alias())

    def matched(self, source: Any) -> A.Matched:
        self.need("MATCH_RECOGNIZE")
        self.need("(")
        out = A.Matched(source, [], [], [], False, "PAST LAST ROW", "", [])
        if self.eat("PARTITION", "BY"):
            out.partition = self.listed(self.expr)
        if self.eat("ORDER", "BY"):
            out.order = self.listed(self.key)
        if self.eat("MEASURES"):
            out.measures = self.listed(lambda: ((self.one_of("FINAL", "RUNNING"), self.expr())[1], (self.need("AS"), self.name())[1]))
        if self.eat("ALL", "ROWS", "PER", "MATCH"):
            out.all_rows = True
        else:
            self.eat("ONE", "ROW", "PER", "MATCH")
        if self.eat("AFTER", "MATCH", "SKIP"):
            out.skip = "TO NEXT ROW" if self.eat("TO", "NEXT", "ROW") else "PAST LAST ROW" if self.eat("PAST", "LAST", "ROW") else ""
            if not out.skip:
                raise SqlError("AFTER MATCH SKIP TO a symbol isn't supported")
        self.need("PATTERN")
        out.pattern = self.raw_parens()
        if self.eat("WITHIN"):
            out.within = self.primary()
        if self.eat("DEFINE"):
            out.define = self.listed(lambda: (self.name(), (self.need("AS"), self.expr())[1]))
        self.need(")")
        out.alias = self.alias()
        return out

    def called(self, call: Any, lateral: bool) -> A.TableCall:
        out = A.TableCall(call, lateral=lateral)
        out.ordinality = self.eat("WITH", "ORDINALITY")
        out.alias = self.alias()
        if out.alias and self.at("("):
            out.columns = self.in_parens(lambda: self.listed(self.name))
        return out

    def after_table(self, out: Any) -> Any:
        while True:
            if self.eat("LATERAL", "VIEW"):
                outer = self.eat("OUTER")
                call = self.primary()
                alias = self.name()
                cols = self.listed(self.name) if self.eat("AS") else []
                out = A.LateralView(out, call, alias, cols, outer)
            elif self.at("PIVOT") or self.at("UNPIVOT"):
                kind = self.name().upper()
                kind += " INCLUDE NULLS" if self.eat("INCLUDE", "NULLS") else ""
                self.eat("EXCLUDE", "NULLS")
                out = A.Pivoted(out, kind, self.raw_parens(), "")
                out.alias = self.alias()
            elif self.at("MATCH_RECOGNIZE", "("):
                out = self.matched(out)
            else:
                return out

    # --- expressions, loosest first

    def expr(self) -> Any:
        first = None
        if self.toks[self.i].upper != "NOT":
            first = self.unary()  # most expressions are one operand: nothing that binds follows
            t = self.toks[self.i]
            if t.upper not in BINDS and t.kind != "param":
                return first
        left = self.xor(first)
        while self.t.upper == "OR" or self.t.text == "||" and not self.d.concat_pipes:
            self.i += 1
            left = A.Bin("OR", left, self.xor())
        if self.t.text == "?" and self.t.kind == "param" and self.ternary():
            self.i += 1
            yes = self.expr()
            self.need(":")
            return A.Case(None, [(left, yes)], self.expr())
        return left

    def ternary(self) -> bool:
        depth, k = 0, 1
        while self.peek(k).kind != "end":
            t = self.peek(k)
            depth += (t.text == "(") - (t.text == ")") if t.kind == "op" else 0
            if depth < 0 or depth == 0 and t.text == ",":
                return False
            if depth == 0 and t.kind == "op" and t.text == ":":
                return True
            k += 1
        return False

    def xor(self, first: Any = None) -> Any:
        left = self.conj(first)
        while self.eat("XOR"):
            left = A.Bin("XOR", left, self.conj())
        return left

    def conj(self, first: Any = None) -> Any:
        left = self.neg(first)
        while self.t.upper == "AND" or self.t.text == "&&" and self.d.name in ("mysql", "hive", "spark"):
            self.i += 1
            left = A.Bin("AND", left, self.neg())
        return left

    def neg(self, first: Any = None) -> Any:
        if first is None and self.eat("NOT"):
            return A.Un("NOT", self.neg())
        return self.comparison(first)

    def comparison(self, first: Any = None) -> Any:
        left = self.bits(first)
        while True:
            t = self.t
            if t.kind == "op" and (t.text in COMPARE or t.text in ("*=", "=*")):
                self.i += 1
                if self.t.upper in ("ANY", "ALL", "SOME") and self.peek().text == "(":
                    kind = "ALL" if self.name().upper() == "ALL" else "ANY"
                    left = A.Quantified(t.text, left, kind, self.in_parens(lambda: self.query() if self.t.upper in ("SELECT", "WITH", "VALUES") else self.expr()))
                else:
                    left = A.Bin(t.text, left, self.bits())
            elif t.kind == "op" and t.text in ("~", "~*", "!~", "!~*"):
                self.i += 1
                pattern = self.bits()
                if "*" in t.text:
                    pattern = A.Bin("||", A.Lit("string", "(?i)"), pattern)
                left = A.Like("RLIKE", left, pattern, None, t.text[0] == "!")
            elif t.kind == "op" and t.text in ("@>", "<@", "?", "?|", "?&") or t.text == "&&" and self.d.name == "postgres":
                self.i += 1
                left = A.Bin(t.text, left, self.bits())
            elif t.upper == "IS":
                self.i += 1
                negated = self.eat("NOT")
                if self.eat("DISTINCT", "FROM"):
                    same = A.Bin("<=>", left, self.bits())
                    left = same if negated else A.Un("NOT", same)
                else:
                    left = A.Is(left, self.one_of("NULL", "TRUE", "FALSE", "UNKNOWN") or "NULL", negated)
            elif t.upper in ("ISNULL", "NOTNULL"):
                self.i += 1
                left = A.Is(left, "NULL", t.upper == "NOTNULL")
            elif t.upper == "OVERLAPS":
                self.i += 1
                left = A.Bin("OVERLAPS", left, self.bits())
            elif self.at("MEMBER", "OF"):
                self.i += 2
                left = A.Call("array_contains", [self.bits(), left])
            else:
                start = self.i
                negated = self.eat("NOT")
                self.eat("GLOBAL")
                if self.eat("NOT"):
                    negated = True
                op = self.one_of("LIKE", "ILIKE", "RLIKE", "REGEXP", "SIMILAR", "BETWEEN", "IN")
                if not op:
                    self.i = start
                    return left
                if op == "SIMILAR":
                    self.need("TO")
                if op == "IN":
                    if self.t.kind == "param":
                        items: Any = self.primary()
                    else:
                        items = self.in_parens(lambda: self.query() if self.t.upper in ("SELECT", "WITH", "VALUES") else [] if self.at(")") else self.listed(self.expr))
                    left = A.In(left, items, negated)
                elif op == "BETWEEN":
                    self.eat("SYMMETRIC")
                    low = self.bits()
                    self.need("AND")
                    left = A.Between(left, low, self.bits(), negated)
                else:
                    pattern = self.bits()
                    escape = self.bits() if self.eat("ESCAPE") else None
                    left = A.Like("RLIKE" if op == "REGEXP" else op, left, pattern, escape, negated)

    def bits(self, first: Any = None) -> Any:
        left = self.add(first)
        while self.t.kind == "op" and self.t.text in ("&", "|", "<<", ">>") or self.t.text == "^" and not self.d.caret_power:
            op = self.t.text
            self.i += 1
            left = A.Bin(op, left, self.add())
        return left

    def add(self, first: Any = None) -> Any:
        left = self.mul(first)
        while self.t.kind == "op" and (self.t.text in ("+", "-") or self.t.text == "||" and self.d.concat_pipes):
            op = self.t.text
            self.i += 1
            left = A.Bin(op, left, self.mul())
        return left

    def mul(self, first: Any = None) -> Any:
        left = self.unary() if first is None else first
        while self.t.kind == "op" and self.t.text in ("*", "/", "%") or self.t.upper in ("DIV", "MOD"):
            op = self.t.upper
            self.i += 1
            left = A.Bin({"MOD": "%"}.get(op, op), left, self.unary())
        return left

    def unary(self) -> Any:
        if self.t.kind == "op" and self.t.text in ("-", "+", "~", "!"):
            op = self.t.text
            self.i += 1
            return A.Un("NOT" if op == "!" else op, self.unary())
        if self.at("PRIOR") or self.at("CONNECT_BY_ROOT") or self.at("BINARY") and self.peek().text not in ("(", ",", ")", "."):
            return A.Un(self.name().upper(), self.unary())
        out = self.postfix(self.primary())
        if self.t.text == "^" and self.d.caret_power:
            self.i += 1
            return A.Call("POWER", [out, self.unary()])
        return out

    def postfix(self, out: Any) -> Any:
        while True:
            if self.eat("::"):
                out = A.Cast(out, self.type())
            elif self.t.text == "[" and self.t.kind == "op":
                self.i += 1
                index = None if self.at(":") or self.t.kind == "param" and self.t.text[0] == ":" else self.expr()
                to, ranged = None, False
                if self.t.kind == "param" and self.t.text[0] == ":" and self.peek().text == "]":  # a[1:2] reads as a, 1 and a parameter
                    text, self.i = self.t.text[1:], self.i + 1
                    ranged, to = True, A.Lit("number", text) if text.isdigit() else A.Name([text])
                elif self.eat(":"):
                    ranged, to = True, None if self.at("]") else self.expr()
                self.need("]")
                out = A.Item(out, index, to, ranged)
            elif self.eat("COLLATE"):
                out = A.Collate(out, ".".join(self.names()))
            elif self.eat("AT", "TIME", "ZONE"):
                out = A.AtZone(out, self.primary())
            elif self.t.kind == "op" and self.t.text in ("->", "->>", "#>", "#>>"):
                op = self.t.text
                self.i += 1
                out = A.Bin(op, out, self.primary())
            elif self.eat("(+)") and isinstance(out, A.Name):
                out.outer = True
            elif self.at(".") and not isinstance(out, A.Name):
                self.i += 1
                out = A.Bin(".", out, A.Name([self.name()]))
            else:
                return out

    def type(self) -> str:
        words = [self.name()]
        while self.t.upper in ("PRECISION", "VARYING", "UNSIGNED", "SIGNED", "WITHOUT", "WITH", "TIME", "ZONE") and not self.at("WITH", "("):
            words.append(self.name())
        out = " ".join(words)
        if self.at("("):
            out += f"({self.raw_parens()})"
        if self.at("<"):
            depth, start = 0, self.t.at
            while True:
                depth += {"<": 1, ">": -1, ">>": -2}.get(self.t.text, 0)
                self.i += 1
                if not depth:
                    break
            out += self.sql[start : self.toks[self.i - 1].end]
        while self.at("[", "]"):
            self.i += 2
            out = f"ARRAY<{out}>"
        return out

    def primary(self) -> Any:
        t = self.t
        if t.kind == "string":
            self.i += 1
            text = t.text
            while self.t.kind == "string" and self.d.name in ("mysql", "postgres"):
                text, self.i = text + self.t.text, self.i + 1
            return A.Lit("string", text)
        if t.kind in ("number", "hex", "bits"):
            self.i += 1
            return A.Lit("hex" if t.text[:2].lower() == "0x" else t.kind, t.text[2:] if t.text[:2].lower() == "0x" else t.text)
        if t.kind == "param":
            self.i += 1
            return A.Param(t.text)
        if t.text == "(" and t.kind == "op":
            self.i += 1
            if self.t.upper in ("SELECT", "WITH", "VALUES") or self.t.text == "(" and self.sub_ahead():
                out: Any = self.query()
                self.need(")")
                out.nested = True
                return out
            if self.eat(")"):
                return A.Row([])
            items = self.listed(self.expr)
            self.need(")")
            return items[0] if len(items) == 1 else A.Row(items)
        if t.text == "{":  # ODBC {fn f(x)}, {d '…'}
            self.i += 1
            word = self.name().upper()
            out = self.expr() if word == "FN" else A.Lit("typed", self.primary().value, {"D": "DATE", "TS": "TIMESTAMP", "T": "TIME"}.get(word, word))
            self.need("}")
            return out
        if t.text == "*" and t.kind == "op":
            self.i += 1
            return A.Star()
        if t.kind not in ("word", "name"):
            raise SqlError(f"unexpected {t.text or 'end'!r} at {t.at}")
        u = t.upper
        after = self.peek()
        if t.kind == "word":
            if u in ("NULL", "TRUE", "FALSE"):
                self.i += 1
                return A.Lit("null" if u == "NULL" else "bool", u)
            if u in ("DATE", "TIMESTAMP", "TIME", "DATETIME") and after.kind == "string":
                self.i += 2
                return A.Lit("typed", after.text, "TIMESTAMP" if u == "DATETIME" else u)
            if u == "INTERVAL" and after.text != "(" or u == "INTERVAL" and self.d.name == "mysql":
                return self.interval()
            if u == "CASE":
                return self.case()
            if u == "EXISTS" and after.text == "(":
                self.i += 1
                return A.Exists(self.in_parens(self.query))
            if u == "ARRAY" and after.text == "[":
                self.i += 2
                items = [] if self.at("]") else self.listed(self.expr)
                self.need("]")
                return A.ArrayOf(items)
            if u == "ROW" and after.text == "(":
                self.i += 1
                return A.Row(self.in_parens(lambda: self.listed(self.expr)))
            if after.text == "(" and u in ("CAST", "TRY_CAST", "SAFE_CAST"):
                self.i += 2
                value = self.expr()
                self.need("AS")
                out = A.Cast(value, self.type(), u != "CAST")
                self.need(")")
                return out
            if after.text == "(" and u in ("CONVERT", "TRY_CONVERT"):
                return self.convert(u)
            if after.text == "(" and u == "EXTRACT":
                self.i += 2
                unit = self.name()
                self.need("FROM")
                out = A.Extract(unit, self.expr())
                self.need(")")
                return out
        parts = [self.name()]
        while self.at(".") and self.peek().kind in ("word", "name"):
            self.i += 1
            parts.append(self.name())
        if self.at("("):
            return self.call(".".join(parts))
        if t.kind == "word" and len(parts) == 1 and u in ("CURRENT_DATE", "CURRENT_TIMESTAMP", "SYSDATE", "LOCALTIMESTAMP", "SYSTIMESTAMP"):
            return A.Call(u)
        return A.Name(parts)

    def sub_ahead(self) -> bool:
        k = 0
        while self.peek(k).text == "(":
            k += 1
        return self.peek(k).upper in ("SELECT", "WITH")

    def interval(self) -> A.Interval:
        self.need("INTERVAL")
        value = self.primary() if self.t.text != "-" else self.unary()
        if self.t.upper in UNITS:
            unit = self.name().upper()
            if self.eat("TO"):
                unit += f" TO {self.name().upper()}"
        else:
            text = value.value.split() if isinstance(value, A.Lit) else []
            if len(text) == 2:
                return A.Interval(A.Lit("number", text[0]), text[1].upper())
            unit = ""
        return A.Interval(value, unit)

    def case(self) -> A.Case:
        self.need("CASE")
        operand = None if self.at("WHEN") else self.expr()
        whens = []
        while self.eat("WHEN"):
            when = self.expr()
            self.need("THEN")
            whens.append((when, self.expr()))
        otherwise = self.expr() if self.eat("ELSE") else None
        self.need("END")
        return A.Case(operand, whens, otherwise)

    def convert(self, word: str) -> Any:
        self.i += 2
        safe = word == "TRY_CONVERT"
        if self.d.name == "sqlserver":
            kind = self.type()
            self.need(",")
            out = A.Cast(self.expr(), kind, safe)
            if self.eat(","):
                self.expr()
        else:
            value = self.expr()
            if self.eat("USING"):
                self.name()
                out = value
            else:
                self.need(",")
                out = A.Cast(value, self.type(), safe)
        self.need(")")
        return out

    def window(self) -> A.Window:
        w = A.Window()
        if self.t.kind in ("word", "name") and self.t.upper not in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS", "DISTRIBUTE", "SORT"):
            w.base = self.name()
        if self.eat("PARTITION", "BY") or self.eat("DISTRIBUTE", "BY"):
            w.partition = self.listed(self.expr)
        if self.eat("ORDER", "BY") or self.eat("SORT", "BY"):
            w.order = self.listed(self.key)
        if self.t.upper in ("ROWS", "RANGE", "GROUPS"):
            start, depth = self.t.at, 0
            while depth or self.t.text != ")":
                depth += (self.t.text == "(") - (self.t.text == ")")
                self.i += 1
            w.frame = self.sql[start : self.t.at].strip()
        return w

    def call(self, name: str) -> A.Call:
        c, u = A.Call(name), name.upper()
        self.need("(")
        if u == "TRIM" and self.t.upper in ("BOTH", "LEADING", "TRAILING"):
            side = self.name().upper()
            chars = A.Lit("string", " ") if self.at("FROM") else self.expr()
            self.need("FROM")
            c.args = [A.Lit("word", side), chars, self.expr()]
            self.need(")")
            return c
        if not self.at(")"):
            c.distinct = bool(self.one_of("DISTINCT", "UNIQUE"))
            self.eat("ALL")
            while True:
                if self.t.upper in UNITS and self.peek().text == ",":  # TIMESTAMPDIFF(DAY, …)
                    c.args.append(A.Lit("word", self.name().upper()))
                elif self.t.upper in ("SELECT", "WITH"):
                    c.args.append(self.query())
                else:
                    c.args.append(self.lambda_or_expr(u))
                if u in ("SUBSTRING", "TRIM", "POSITION", "OVERLAY") and self.t.upper in ("FROM", "FOR", "IN", "PLACING"):
                    self.i += 1
                elif not self.eat(","):
                    break
            if self.at("IGNORE", "NULLS") or self.at("RESPECT", "NULLS"):
                c.nulls = self.name().upper()
                self.i += 1
            if self.eat("ORDER", "BY"):
                c.order = self.listed(self.key)
            if self.eat("SEPARATOR"):
                c.separator = self.primary()
        self.need(")")
        if self.at("(") and self.d.name == "clickhouse":
            c.params = c.args
            c.args = self.in_parens(lambda: [] if self.at(")") else self.listed(self.expr))
        while True:
            if self.eat("WITHIN", "GROUP"):
                c.within = self.in_parens(lambda: (self.need("ORDER", "BY"), self.listed(self.key))[1])
            elif self.at("FILTER", "("):
                self.i += 1
                c.filter = self.in_parens(lambda: (self.need("WHERE"), self.expr())[1])
            elif self.at("KEEP", "("):
                self.i += 1
                self.need("(")
                self.need("DENSE_RANK")
                side = self.one_of("FIRST", "LAST")
                self.need("ORDER", "BY")
                c.keep = (side, self.listed(self.key))
                self.need(")")
            elif self.at("IGNORE", "NULLS") or self.at("RESPECT", "NULLS"):
                c.nulls = self.name().upper()
                self.i += 1
            elif self.eat("OVER"):
                c.over = self.in_parens(self.window) if self.at("(") else A.Window(base=self.name())
            else:
                return c

    def lambda_or_expr(self, function: str) -> Any:
        if self.t.kind in ("word", "name") and self.peek().text == "." and self.peek(2).text == "*":  # COUNT(a.*)
            return self.star()
        if self.t.kind == "word" and self.peek().text == "->" and self.d.name in ("spark", "presto", "clickhouse", "hive"):
            name = self.name()
            self.i += 1
            return A.Bin("->", A.Lit("word", name), self.expr())
        return self.expr()

    # --- statements

    def statement(self) -> Any:
        start = self.t.at
        u = self.t.upper
        if u in ("SELECT", "WITH", "VALUES", "(") or self.t.text == "(":
            out = self.query()
            if u == "WITH" and self.t.upper in ("INSERT", "UPDATE", "DELETE", "MERGE"):
                raise SqlError("WITH before a write isn't supported: put it into the statement's query")
        elif u in WRITES:
            out = getattr(self, WRITES[u])()
            out.text = self.sql[start : self.t.at].strip()
        else:
            out = self.other(u)
            while self.t.kind != "end" and self.t.text != ";":
                self.i += 1
            out.text = self.sql[start : self.t.at].strip()
        if self.t.kind != "end" and self.t.text != ";":
            raise SqlError(f"unexpected {self.t.text!r} at {self.t.at}")
        return out

    def row(self) -> A.Row:
        return A.Row(self.in_parens(lambda: self.listed(self.default_or_expr)))

    def default_or_expr(self) -> Any:
        return A.Lit("null", "NULL") if self.eat("DEFAULT") else self.expr()

    def assignment(self) -> tuple[Any, Any]:
        name = A.Name(self.names())
        self.need("=")
        return name, self.default_or_expr()

    def returning(self, s: A.Statement) -> None:
        if self.eat("RETURNING"):
            s.returning = self.listed(self.item)

    def insert(self) -> A.Statement:
        s = A.Statement("INSERT", "", verb=self.name().upper())
        if self.t.upper in ("ALL", "FIRST") and self.peek().upper in ("WHEN", "INTO"):
            return self.insert_many(s)
        self.eat("IGNORE") and setattr(s, "conflict", A.Conflict())
        s.overwrite = self.eat("OVERWRITE")
        if s.verb == "REPLACE":
            s.conflict = A.Conflict(replace=True)
        self.eat("INTO")
        self.eat("TABLE")
        s.target = self.names()
        if self.eat("PARTITION"):
            s.options["partition"] = self.raw_parens()
        alias = self.alias() if self.at("AS") else ""
        if self.at("(") and self.peek().upper not in ("SELECT", "WITH", "(", "VALUES"):
            s.columns = self.in_parens(lambda: self.listed(self.name))
        if self.eat("OUTPUT"):
            s.returning = self.listed(self.item)
        if self.eat("VALUES") or self.eat("VALUE"):
            s.rows = self.listed(self.row)
            if self.eat("AS"):
                alias = self.name()
        elif self.eat("SET"):
            pairs = self.listed(self.assignment)
            s.columns, s.rows = [n.parts[-1] for n, _ in pairs], [A.Row([v for _, v in pairs])]
        elif self.eat("DEFAULT", "VALUES"):
            s.rows = [A.Row([])]
        else:
            s.query = self.query()
        s.options |= {"alias": alias} if alias else {}
        if self.eat("ON", "DUPLICATE", "KEY", "UPDATE"):
            s.conflict = A.Conflict([], self.listed(self.assignment))
        elif self.eat("ON", "CONFLICT"):
            keys = self.in_parens(lambda: self.listed(self.name)) if self.at("(") else []
            self.need("DO")
            s.conflict = A.Conflict(keys)
            if not self.eat("NOTHING"):
                self.need("UPDATE", "SET")
                s.conflict.assignments = self.listed(self.assignment)
                s.conflict.where = self.expr() if self.eat("WHERE") else None
        self.returning(s)
        return s

    def insert_many(self, s: A.Statement) -> A.Statement:
        s.kind, s.verb = "INSERT ALL", self.name().upper()

        def into(when: Any) -> None:
            while self.eat("INTO"):
                a = A.Action("INTO", when, target=self.names())
                a.columns = self.in_parens(lambda: self.listed(self.name)) if self.at("(") else []
                a.values = self.in_parens(lambda: self.listed(self.default_or_expr)) if self.eat("VALUES") else []
                s.actions.append(a)

        if self.at("INTO"):
            into(None)
        while self.eat("WHEN"):
            when = self.expr()
            self.need("THEN")
            into(when)
        if self.eat("ELSE"):
            s.options["else"] = str(len(s.actions))
            into(A.Lit("word", "ELSE"))
        s.query = self.query()
        s.target = s.actions[0].target if s.actions else []
        return s

    def update(self) -> A.Statement:
        s = A.Statement("UPDATE", "", verb=self.name().upper())
        s.source = self.sources()
        s.target = next((x.parts for x in A.walk(s.source) if isinstance(x, A.Table)), [])
        self.need("SET")
        s.assignments = self.listed(self.assignment)
        if self.eat("OUTPUT"):
            s.returning = self.listed(self.item)
        if self.eat("FROM"):
            s.source = A.Join("CROSS", s.source, self.sources())
        self.where_tail(s)
        return s

    def delete(self) -> A.Statement:
        s = A.Statement("DELETE", "", verb=self.name().upper())
        named = None
        if not self.at("FROM"):
            named = self.names()  # DELETE t FROM …
            if self.at(","):
                raise SqlError("DELETE from several tables at once isn't supported")
        self.need("FROM")
        s.source = self.sources()
        if self.eat("USING"):
            if named is None and isinstance(s.source, A.Table):
                s.source = A.Join("CROSS", s.source, self.sources())
            else:
                raise SqlError("DELETE USING needs one target")
        tables = [x for x in A.walk(s.source) if isinstance(x, A.Table)]
        target = next((x for x in tables if named and named[-1].lower() in ((x.alias or x.parts[-1]).lower(), x.parts[-1].lower())), tables[0] if tables and not named else None)
        if target is None:
            raise SqlError("DELETE names a table that FROM doesn't")
        s.target, s.options = target.parts, {"of": target.alias or target.parts[-1]}
        if self.eat("OUTPUT"):
            s.returning = self.listed(self.item)
        self.where_tail(s)
        return s

    def where_tail(self, s: A.Statement) -> None:
        s.where = self.expr() if self.eat("WHERE") else None
        if self.eat("ORDER", "BY"):
            s.order = self.listed(self.key)
        if self.eat("LIMIT"):
            s.limit = self.bits()
        self.returning(s)

    def merge(self) -> A.Statement:
        s = A.Statement("MERGE", "", verb=self.name().upper())
        self.eat("INTO")
        target = self.table()
        s.target = target.parts
        self.need("USING")
        s.source = A.Join("CROSS", target, self.table())
        self.need("ON")
        s.on = self.expr()
        while self.eat("WHEN"):
            a = A.Action("NOT MATCHED" if self.eat("NOT") else "MATCHED")
            self.need("MATCHED")
            if self.eat("BY", "SOURCE"):
                a.kind = "BY SOURCE"
            else:
                self.eat("BY", "TARGET")
            if self.eat("AND"):
                a.when = self.expr()
            self.need("THEN")
            if self.eat("DELETE"):
                a.delete = True
            elif self.eat("UPDATE"):
                self.need("SET")
                a.assignments = [(A.Star(), A.Star())] if self.eat("*") else self.listed(self.assignment)
                if self.eat("WHERE"):
                    a.when = _and(a.when, self.expr())
            elif self.eat("DO", "NOTHING"):
                pass
            else:
                self.need("INSERT")
                if self.eat("*"):
                    a.values = [A.Star()]
                else:
                    a.columns = self.in_parens(lambda: self.listed(lambda: self.names()[-1])) if self.at("(") else []
                    self.need("VALUES")
                    a.values = self.in_parens(lambda: self.listed(self.default_or_expr))
                    if self.eat("WHERE"):
                        a.when = _and(a.when, self.expr())
            s.actions.append(a)
        self.returning(s)
        return s

    def load(self) -> A.Statement:
        """LOAD DATA [LOCAL] INFILE 'f' [REPLACE|IGNORE] INTO TABLE t [FIELDS TERMINATED BY 'c' [ENCLOSED BY 'q']] [LINES TERMINATED BY 'c'] [IGNORE n LINES] [(cols)]."""
        s = A.Statement("LOAD", "", verb=self.name().upper(), options={"sep": "\t", "quote": "", "skip": "0"})
        self.need("DATA")
        self.eat("LOCAL")
        self.need("INFILE")
        s.options["path"] = self.value()
        self.one_of("REPLACE", "IGNORE")
        self.need("INTO", "TABLE")
        s.target = self.names()
        while self.t.kind != "end" and self.t.text != ";":
            if self.one_of("FIELDS", "COLUMNS"):
                part = {"TERMINATED": "sep", "ENCLOSED": "quote", "ESCAPED": "escape"}
                self.eat("OPTIONALLY")
                while self.t.upper in part or self.at("OPTIONALLY"):
                    self.eat("OPTIONALLY")
                    key = part[self.name().upper()]
                    self.need("BY")
                    s.options[key] = self.value()
            elif self.eat("LINES"):
                self.need("TERMINATED", "BY")
                s.options["line"] = self.value()
            elif self.eat("IGNORE"):
                s.options["skip"] = self.value()
                self.one_of("LINES", "ROWS")
            elif self.at("("):
                s.columns = self.in_parens(lambda: self.listed(self.name))
            else:
                raise SqlError(f"unexpected {self.t.text!r} at {self.t.at}")
        return s

    def copy(self) -> A.Statement:
        """COPY t [(cols)] | (query) FROM | TO 'f' [WITH] (FORMAT csv, HEADER, DELIMITER ';') or the old form without parentheses."""
        s = A.Statement("COPY", "", verb=self.name().upper(), options={"sep": ",", "quote": '"', "header": "false"})
        if self.at("("):
            s.query = self.in_parens(self.query)
        else:
            s.target = self.names()
            s.columns = self.in_parens(lambda: self.listed(self.name)) if self.at("(") else []
        s.options["way"] = self.one_of("FROM", "TO")
        if not s.options["way"]:
            raise SqlError(f"expected FROM or TO at {self.t.at}")
        s.options["path"] = self.value()
        self.eat("WITH")
        keys = {"DELIMITER": "sep", "QUOTE": "quote", "NULL": "null", "FORMAT": "format", "ESCAPE": "escape", "ENCODING": "encoding"}

        def option() -> None:
            key = self.value().upper()
            if key == "HEADER":
                s.options["header"] = "false" if self.one_of("FALSE", "OFF") else "true"
                self.one_of("TRUE", "ON")
            elif key == "CSV":
                s.options["format"] = "csv"
            elif key in keys:
                self.eat("AS")
                s.options[keys[key]] = self.value()
            else:
                raise SqlError(f"unknown option {key}")

        if self.at("("):
            self.in_parens(lambda: self.listed(option))
        while self.t.kind != "end" and self.t.text != ";":
            option()
        return s

    def other(self, u: str) -> A.Statement:
        s = A.Statement("OTHER", "", verb=u)
        if u in ("CREATE", "ALTER", "DROP", "TRUNCATE", "RENAME", "COMMENT"):
            first = self.i
            s.kind, self.i = "DDL", self.i + 1
            while self.t.kind == "word" and self.t.upper in ("OR", "REPLACE", "TEMP", "TEMPORARY", "TABLE", "VIEW", "INDEX", "UNIQUE", "IF", "NOT", "EXISTS", "GLOBAL", "MATERIALIZED", "EXTERNAL", "DATABASE", "SCHEMA", "PROCEDURE", "FUNCTION", "SEQUENCE"):
                self.i += 1
            if self.t.kind in ("word", "name"):
                s.target = self.names()
            while self.t.kind != "end" and self.t.text != ";" and not (self.t.upper == "AS" and self.peek().upper in ("SELECT", "WITH")):
                self.i += 1
            if self.eat("AS"):
                s.options["head"] = self.sql[self.toks[first].at : self.toks[self.i - 1].end]
                s.query = self.query()
        elif u in ("SET", "USE", "SHOW", "EXPLAIN", "DESC", "DESCRIBE"):
            s.kind = u
        elif u in ("CALL", "EXEC", "EXECUTE"):
            s.kind, self.i = "CALL", self.i + 1
            if self.t.kind in ("word", "name"):
                s.target = self.names()
        elif u not in VERBS and self.t.kind != "end":
            raise SqlError(f"no statement starts with {self.t.text!r}")
        return s


WRITES = {"INSERT": "insert", "REPLACE": "insert", "UPDATE": "update", "DELETE": "delete", "MERGE": "merge", "LOAD": "load", "COPY": "copy"}
#: First words of statements that are known, but only passed on.
VERBS = set(
    "GRANT REVOKE DENY LOCK UNLOCK FLUSH PREPARE DEALLOCATE BEGIN START COMMIT ROLLBACK SAVEPOINT RELEASE ANALYZE OPTIMIZE VACUUM KILL DECLARE RETURN IF WHILE LOOP REPEAT FOR OPEN FETCH CLOSE SIGNAL RESIGNAL LEAVE ITERATE "
    "REFRESH CACHE UNCACHE MSCK RESET CLEAR ADD LIST CHECKPOINT CLUSTER REINDEX DISCARD LISTEN NOTIFY UNLISTEN ATTACH DETACH PRAGMA PURGE FLASHBACK AUDIT NOAUDIT HANDLER DO HELP CHANGE STOP INSTALL UNINSTALL XA PRINT GO END".split()
)


def _and(a: Any, b: Any) -> Any:
    return b if a is None else a if b is None else A.Bin("AND", a, b)


def parse_all(sql: str, d: str | Dialect = "mysql") -> list[Any]:
    """The statements of a script."""
    p, out = Parser(sql, d), []
    while p.t.kind != "end":
        if p.eat(";"):
            continue
        out.append(p.statement())
    return out


def parse(sql: str, d: str | Dialect = "mysql") -> Any:
    """The only statement; a text of comments alone is an OTHER statement."""
    found = parse_all(sql, d)
    if not found:
        return A.Statement("OTHER", sql.strip())
    if len(found) > 1:
        raise SqlError(f"{len(found)} statements where one was expected")
    return found[0]


def parse_expr(text: str, d: str | Dialect = "mysql") -> Any:
    p = Parser(text, d)
    out = p.expr()
    if p.t.kind != "end":
        raise SqlError(f"unexpected {p.t.text!r} at {p.t.at}")
    return out
