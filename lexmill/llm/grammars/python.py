"""Python 3.13: a line-structured lexer and a grammar over its token kinds.

The lexer yields kinds (keywords and operators stand for themselves) and the
offset of each token; what it cannot read becomes an ERROR token, at which the
grammar then fails.
"""

from __future__ import annotations

import re
import unicodedata

from lexmill.llm.grammars.packrat import compile_grammar

# The hard keywords of the language.
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
SOFT = frozenset(["match", "case", "type", "_"])

_BLANK = re.compile(r"[ \t\f]*")
_SKIP = re.compile(r"(?:[ \t\f]+|\\\n)*(?:#[^\n]*)?")
_NAME = re.compile(r"[^\W\d]\w*")
_NUMBER = re.compile(
    r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    r"|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][-+]?[0-9](?:_?[0-9])*)?[jJ]?"
    r"|[0-9](?:_?[0-9])*[eE][-+]?[0-9](?:_?[0-9])*[jJ]?|[0-9](?:_?[0-9])*[jJ]|(?:0(?:_?0)*|[1-9](?:_?[0-9])*)"
)
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b|(?![\w.])|\.(?!\w)")
_STRING = re.compile(r"([rRbBuUfF]{0,2})(\"\"\"|'''|\"|')")
_PREFIXES = frozenset(["", "r", "b", "u", "f", "rb", "br", "rf", "fr"])
_REST = {
    "'": re.compile(r"[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"),
    '"': re.compile(r'[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"'),
    "'''": re.compile(r"[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'''"),
    '"""': re.compile(r'[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""'),
}
_OP = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|->|:=|[-+*/%&|^@]=|[-+*/%@&|^~<>()\[\]{},:.;=]")
_AUGMENTED = frozenset(["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="])
_BAD_ESCAPE = re.compile(r"(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|(?:u(?![0-9a-fA-F]{4})|U(?!000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N(?!\{[^}]+\})))")
_BAD_BYTE_ESCAPE = re.compile(r"(?:\\\\)*\\x(?![0-9a-fA-F]{2})")
_CLOSES = {"(": ")", "[": "]", "{": "}"}


# Fixed values of the language's tokenizer: open brackets, and indentations with the outermost.
MOST_BRACKETS, MOST_INDENTS = 200, 100


def _bad_escapes(body: str, prefix: str) -> bool:
    if "\\" not in body or "r" in prefix:
        return False
    rx, at = (_BAD_BYTE_ESCAPE if "b" in prefix else _BAD_ESCAPE), 0
    while (at := body.find("\\", at)) >= 0:
        if rx.match(body, at) and body[at + 1] != "\\":
            return True
        at += 2
    if "b" not in prefix:
        for name in re.findall(r"(?<!\\)(?:\\\\)*\\N\{([^}]*)\}", body):
            try:
                unicodedata.lookup(name)
            except KeyError:
                return True
    return False


def lex(text: str) -> tuple[list[str], list[int]]:
    """Token kinds and their offsets in ``text`` after line ends were made \\n."""
    kinds: list[str] = []
    offsets: list[int] = []
    n, at, depth = len(text), 0, 0
    indents = [(0, 0)]
    brackets: list[str] = []
    fields: list[tuple] = []  # open replacement fields: (quote, raw, bracket depth, in a format spec)

    def put(kind: str, where: int) -> None:
        kinds.append(kind)
        offsets.append(where)

    def fail(where: int) -> tuple[list[str], list[int]]:
        put("ERROR", where)
        put("END", where)
        return kinds, offsets

    def middle(at: int, quote: str, raw: bool, spec: bool) -> tuple[str, int]:
        """Literal part of an f-string: ('{' | 'end' | '}' | 'bad', place after or of it)."""
        while at < n:
            c = text[at]
            if c == "\\" and not spec and not raw:
                if text.startswith("\\N{", at):
                    end = text.find("}", at)
                    if end < 0:
                        return "bad", at
                    at = end + 1
                elif text[at + 1 : at + 2] in ("{", "}"):
                    at += 1
                else:
                    at += 2
            elif c == "\\" and raw and text[at + 1 : at + 2] not in ("{", "}"):
                at += 2
            elif c == "{":
                if text.startswith("{{", at) and not spec:
                    at += 2
                else:
                    return "{", at
            elif c == "}":
                if spec:
                    return "}", at
                if text.startswith("}}", at):
                    at += 2
                else:
                    return "bad", at
            elif text.startswith(quote, at):
                return ("bad", at) if spec else ("end", at + len(quote))
            elif c == "\n" and len(quote) == 1:
                return "bad", at
            else:
                at += 1
        return "bad", at

    def literal(at: int, quote: str, raw: bool, spec: bool) -> int:
        """Reads on in an f-string after ``at``; -1 if it is broken."""
        nonlocal depth
        what, to = middle(at, quote, raw, spec)
        if what == "bad":
            put("ERROR", to)
            return -1
        if what == "{":
            put("FM", at)
            put("{", to)
            brackets.append("{")
            depth += 1
            fields.append((quote, raw, depth))
            return to + 1
        put("FM", at)
        if what == "end":
            put("FE", to - len(quote))
            return to
        put("}", to)
        brackets.pop()
        depth -= 1
        fields.pop()
        return literal_after(to + 1, quote, raw)

    def literal_after(at: int, quote: str, raw: bool) -> int:
        """After a closed field: the literal it stood in, which may be a format spec."""
        while specs and specs[-1][0] > depth:
            specs.pop()
        spec = bool(specs and specs[-1] == (depth, quote))
        return literal(at, quote, raw, spec)

    specs: list[tuple] = []  # format specs that are open: (depth of their field, quote)
    if "\x00" in text:
        return fail(text.index("\x00"))
    start_of_line = True
    while True:
        if start_of_line and not depth:
            start_of_line = False
            m = _BLANK.match(text, at)
            blank, line = m[0], at
            at = m.end()
            if at >= n:
                break
            if text[at] in "#\n" or text.startswith("\\\n", at) and False:
                end = text.find("\n", at)
                if end < 0:
                    at = n
                    break
                at, start_of_line = end + 1, True
                continue
            col = alt = 0
            for c in blank:
                if c == " ":
                    col, alt = col + 1, alt + 1
                elif c == "\t":
                    col, alt = (col // 8 + 1) * 8, alt + 1
                else:
                    col = alt = 0
            top = indents[-1]
            if col == top[0]:
                if alt != top[1]:
                    return fail(at)
            elif col > top[0]:
                if alt <= top[1]:
                    return fail(at)
                if len(indents) >= MOST_INDENTS:
                    return fail(at)
                indents.append((col, alt))
                put("INDENT", line)
            else:
                while col < indents[-1][0]:
                    indents.pop()
                    put("DEDENT", at)
                if indents[-1] != (col, alt):
                    return fail(at)
        at = _SKIP.match(text, at).end()
        if at >= n:
            break
        c = text[at]
        if c == "\n":
            if not depth:
                if kinds and kinds[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                    put("NEWLINE", at)
                start_of_line = True
            at += 1
            continue
        if fields and depth == fields[-1][2]:
            quote, raw, _ = fields[-1]
            if c == "}":
                put("}", at)
                brackets.pop()
                depth -= 1
                fields.pop()
                at = literal_after(at + 1, quote, raw)
                while specs and specs[-1][0] > depth:
                    specs.pop()
                if at < 0:
                    put("END", n)
                    return kinds, offsets
                continue
            if c == ":":
                put(":", at)
                specs.append((depth, quote))
                at = literal(at + 1, quote, raw, True)
                while specs and specs[-1][0] > depth:
                    specs.pop()
                if at < 0:
                    put("END", n)
                    return kinds, offsets
                continue
            if c == "!" and not text.startswith("!=", at):
                put("!", at)
                at += 1
                continue
            if c == "=" and not text.startswith("==", at):
                put("=", at)
                at += 1
                continue
        m = _STRING.match(text, at) if c in "\"'rRbBuUfF" else None
        if m and m[1].lower() in _PREFIXES:
            prefix, quote = m[1].lower(), m[2]
            if "f" in prefix:
                put("FS", at)
                at = literal(m.end(), quote, "r" in prefix, False)
                if at < 0:
                    put("END", n)
                    return kinds, offsets
                continue
            e = _REST[quote].match(text, m.end())
            if not e:
                return fail(at)
            body = text[m.end() : e.end() - len(quote)]
            if _bad_escapes(body, prefix) or "b" in prefix and not body.isascii():
                return fail(at)
            put("BYTES" if "b" in prefix else "STRING", at)
            at = e.end()
            continue
        m = _NAME.match(text, at)
        if m:
            word = m[0]
            if not word.isascii() and not unicodedata.normalize("NFKC", word).isidentifier():
                return fail(at)
            put(word if word in KEYWORDS or word in SOFT else "NAME", at)
            at = m.end()
            continue
        if c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit():
            m = _NUMBER.match(text, at)
            if not m or not _AFTER_NUMBER.match(text, m.end()):
                return fail(at)
            put("NUMBER", at)
            at = m.end()
            continue
        m = _OP.match(text, at)
        if not m:
            return fail(at)
        op = m[0]
        if op in "([{":
            if depth >= MOST_BRACKETS:
                return fail(at)
            brackets.append(op)
            depth += 1
        elif op in ")]}":
            if not brackets or _CLOSES[brackets.pop()] != op:
                return fail(at)
            depth -= 1
        put("AUG" if op in _AUGMENTED else op, at)
        at = m.end()
    if depth == 0:
        if kinds and kinds[-1] not in ("NEWLINE", "DEDENT"):
            put("NEWLINE", n)
        for _ in indents[1:]:
            put("DEDENT", n)
    put("END", n)
    return kinds, offsets


GRAMMAR = """
file <- statement* 'END'
block <- 'NEWLINE' 'INDENT' statement+ 'DEDENT' / simples
statement <- compound / simples
simples <- simple (';' simple)* ';'? 'NEWLINE'
simple <- 'return' star_expressions? / 'pass' / 'import' dotted_as (',' dotted_as)* / import_from
  / 'raise' (expression ('from' expression)?)? / 'del' del_targets &<SMALL_END> / 'assert' expression (',' expression)?
  / 'break' / 'continue' / 'global' name (',' name)* / 'nonlocal' name (',' name)*
  / type_alias / !<KEYWORD_ONLY> assignment / star_expressions !<ASSIGN> / yield_expr !<ASSIGN>
type_alias <- 'type' name type_params? '=' expression
name <- <NAMES>
assignment <- name ':' expression ('=' annotated)? / ('(' single_target ')' / attr_target) ':' expression ('=' annotated)?
  / (star_targets '=')+ annotated !'=' / single_target 'AUG' annotated
annotated <- yield_expr / star_expressions
single_target <- attr_target / name / '(' single_target ')'
star_targets <- star_target (',' star_target)* ','?
star_target <- '*' !'*' star_target / attr_target / star_atom
star_atom <- name / '(' (star_target (',' star_target)* ','?)? ')' / '[' (star_target (',' star_target)* ','?)? ']'
attr_target <- atom (trailer &<TRAILER>)* ('.' name / '[' slices ']') !<TRAILER>
del_targets <- del_target (',' del_target)* ','?
del_target <- attr_target / name / '(' del_targets? ')' / '[' del_targets? ']'
import_from <- 'from' <DOTS>* dotted_name 'import' from_names / 'from' <DOTS>+ 'import' from_names
from_names <- '(' as_name (',' as_name)* ','? ')' / as_name (',' as_name)* !',' / '*'
as_name <- name ('as' name)?
dotted_as <- dotted_name ('as' name)?
dotted_name <- name ('.' name)*

compound <- &<DEF> ('@' named NEWLINE_)* ('async'? 'def' name type_params? '(' params? ')' ('->' expression)? ':' block / class_def)
  / 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
  / 'async'? with_or_for / 'try' ':' block try_rest / 'while' named ':' block ('else' ':' block)? / match_statement
NEWLINE_ <- 'NEWLINE'
class_def <- 'class' name type_params? ('(' arguments? ')')? ':' block
with_or_for <- 'for' star_targets 'in' star_expressions ':' block ('else' ':' block)? / with_statement
with_statement <- 'with' '(' with_item (',' with_item)* ','? ')' ':' block / 'with' with_item (',' with_item)* ':' block
with_item <- expression 'as' star_target &<ITEM_END> / expression
try_rest <- 'finally' ':' block / except+ ('else' ':' block)? ('finally' ':' block)? / except_star+ ('else' ':' block)? ('finally' ':' block)?
except <- 'except' (expression ('as' name)?)? ':' block
except_star <- 'except' '*' expression ('as' name)? ':' block
type_params <- '[' type_param (',' type_param)* ','? ']'
type_param <- '*' name ('=' star_expression)? / '**' name ('=' expression)? / name (':' expression)? ('=' expression)?

params <- plain+ slash plain* default* rest? / plain* default+ slash default* rest? / plain+ default* rest? / default+ rest? / rest
plain <- param !'=' (',' / &')')
default <- param '=' expression (',' / &')')
slash <- '/' (',' / &')')
param <- name (':' expression)?
rest <- '*' name (':' star_expression)? (',' / &')') maybe* double_star? / '*' ',' maybe+ double_star? / double_star
maybe <- param ('=' expression)? (',' / &')')
double_star <- '**' param !'=' ','? &')'
lparams <- lplain+ lslash lplain* ldefault* lrest? / lplain* ldefault+ lslash ldefault* lrest? / lplain+ ldefault* lrest? / ldefault+ lrest? / lrest
lplain <- name !'=' (',' / &':')
ldefault <- name '=' expression (',' / &':')
lslash <- '/' (',' / &':')
lrest <- '*' name (',' / &':') lmaybe* ldouble? / '*' ',' lmaybe+ ldouble? / ldouble
lmaybe <- name ('=' expression)? (',' / &':')
ldouble <- '**' name !'=' ','? &':'

match_statement <- 'match' (star_named ',' star_named_list? / named) ':' 'NEWLINE' 'INDENT' case_block+ 'DEDENT'
case_block <- 'case' patterns ('if' named)? ':' block
patterns <- (star_pattern ',' (star_pattern (',' star_pattern)* ','?)?) / pattern
pattern <- or_pattern ('as' !'_' name !<DOT_PAREN_EQ>)?
or_pattern <- closed_pattern ('|' closed_pattern)*
closed_pattern <- number_literal !<PLUS_MINUS> / complex_literal / strings / 'None' / 'True' / 'False'
  / name_or_attr '(' pattern_arguments? ')' / name ('.' name)+ !<DOT_PAREN_EQ> / name !<DOT_PAREN_EQ>
  / '(' pattern ')' / '[' maybe_sequence? ']' / '(' (star_pattern ',' maybe_sequence?)? ')' / '{' mapping? '}'
name_or_attr <- name ('.' name)*
number_literal <- '-'? 'NUMBER'
complex_literal <- '-'? 'NUMBER' <PLUS_MINUS> 'NUMBER'
maybe_sequence <- star_pattern (',' star_pattern)* ','?
star_pattern <- '*' name / pattern
mapping <- '**' name ','? / pair (',' pair)* (',' '**' name)? ','?
pair <- (complex_literal / number_literal / strings / 'None' / 'True' / 'False' / name ('.' name)+) ':' pattern
pattern_arguments <- keyword_pattern (',' keyword_pattern)* ','? / pattern !'=' (',' !keyword_pattern pattern)* (',' keyword_pattern (',' keyword_pattern)*)? ','?
keyword_pattern <- name '=' pattern

star_expressions <- star_expression (',' star_expression)* ','?
star_expression <- '*' bitor / expression
star_named_list <- star_named (',' star_named)* ','?
star_named <- '*' bitor / named
named <- name ':=' expression / expression !':='
yield_expr <- 'yield' 'from' expression / 'yield' star_expressions?
expression <- disjunction ('if' disjunction 'else' expression)? / 'lambda' lparams? ':' expression
disjunction <- inversion (<AND_OR> inversion)*
inversion <- 'not'* bitor (comparison bitor)*
comparison <- <COMPARE> / 'in' / 'not' 'in' / 'is' 'not'?
bitor <- unary (<BINARY> unary)*
unary <- <UNARY>* 'await'? primary
primary <- atom trailer*
trailer <- '.' name / '(' call / '[' slices ']'
call <- ')' / arguments ')' / generator ')'
generator <- (name ':=' expression / expression !':=') for_if
for_if <- ('async'? 'for' star_targets 'in' disjunction ('if' disjunction)*)+
arguments <- positional (',' positional)* (',' keywords)? ','? &')' / keywords ','? &')'
positional <- '*' expression / (name ':=' expression / expression !':=') !'=' !<FOR>
keywords <- star_or_keyword (',' star_or_keyword)* (',' double_or_keyword (',' double_or_keyword)*)? / double_or_keyword (',' double_or_keyword)*
star_or_keyword <- name '=' expression / '*' expression
double_or_keyword <- name '=' expression / '**' expression
slices <- slice !',' / (slice / '*' expression) (',' (slice / '*' expression))* ','?
slice <- expression? ':' expression? (':' expression?)? / named
atom <- name / strings / 'NUMBER' / 'None' / 'True' / 'False' / '(' parenthesised / '[' bracketed / '{' braced / '...'
parenthesised <- ')' / yield_expr ')' / named ')' / named for_if ')' / star_named ',' star_named_list? ')'
bracketed <- ']' / named for_if ']' / star_named_list ']'
braced <- '}' / key_value for_if '}' / double_starred (',' double_starred)* ','? '}' / named for_if '}' / star_named_list '}'
key_value <- expression ':' expression
double_starred <- '**' bitor / key_value
strings <- (fstring / 'STRING')+ !'BYTES' / 'BYTES'+ !<TEXT>
fstring <- 'FS' ('FM' / field)* 'FE'
field <- '{' annotated '='? ('!' name)? (':' ('FM' / field)*)? '}'
"""

_SETS = {
    "NAMES": frozenset(["NAME", *SOFT]),
    "DOTS": frozenset([".", "..."]),
    "TRAILER": frozenset([".", "(", "["]),
    "SMALL_END": frozenset([";", "NEWLINE"]),
    "ASSIGN": frozenset(["=", "AUG", ":", ":="]),
    "DEF": frozenset(["@", "async", "def", "class"]),
    "KEYWORD_ONLY": frozenset(["yield", "lambda", "not", "await"]),
    "ITEM_END": frozenset([",", ")", ":"]),
    "DOT_PAREN_EQ": frozenset([".", "(", "="]),
    "PLUS_MINUS": frozenset(["+", "-"]),
    "AND_OR": frozenset(["and", "or"]),
    "COMPARE": frozenset(["<", ">", "==", ">=", "<=", "!="]),
    "BINARY": frozenset(["|", "^", "&", "<<", ">>", "+", "-", "*", "/", "//", "%", "@", "**"]),
    "UNARY": frozenset(["+", "-", "~"]),
    "FOR": frozenset(["for", "async"]),
    "TEXT": frozenset(["STRING", "FS"]),
}

_parse = compile_grammar(GRAMMAR, "file", True, _SETS)


def furthest_failure(text: str) -> int:
    """Offset of the furthest failure, or -1 if the whole text is valid."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    kinds, offsets = lex(text)
    end, far = _parse(kinds)
    return -1 if end == len(kinds) else offsets[min(far, len(offsets) - 1)]
