"""PowerShell as a character grammar.

It covers scripts of functions, control flow, pipelines, strings of all kinds
and expressions; class bodies are read as balanced blocks.  Keywords are read
without case.  Command arguments are words, strings, variables and bracketed
expressions; the first operator that cannot continue a pipeline fails.
"""

from __future__ import annotations

from lexmill.llm.grammars.packrat import compile_grammar

GRAMMAR = """
script <- ~bom~ ~nl~ (using ~nl~)* (attributes ~nl~)? (params ~nl~)? (named_block ~nl~)* (statement terminator)* statement? ~nl~ ~end~
using <- ~k_using~ ~ws~ ~to_line_end~
block_items <- (attributes ~nl~)? (params ~nl~)? (named_block ~nl~)* (statement terminator)* statement? ~nl~
terminator <- ~ws~ ~separator~ ~nl~
params <- ~k_param~ ~nl~ '(' ~nl~ (param_item (~nl~ ',' ~nl~ param_item)*)? ~nl~ ')' ~semis~
param_item <- (attribute ~nl~)* ~variable~ (~nl~ '=' ~nl~ expression)?
attributes <- (attribute ~nl~)+ &~k_param~
attribute <- '[' ~nl~ ~type_name~ ~nl~ ('(' ~nl~ (attr_arg (~nl~ ',' ~nl~ attr_arg)*)? ~nl~ ')')? ~nl~ ']'
attr_arg <- ~word~ ~nl~ '=' ~nl~ expression / expression / ~word~
named_block <- ~k_named_block~ ~nl~ block ~semis~
block <- '{' ~nl~ block_items '}'
statement <- ~label~? (function / if / foreach / for / while / do / switch / try / trap / class / data / flow / assignment_or_pipeline)
function <- ~k_function~ ~ws1~ ~function_name~ ~nl~ ('(' ~nl~ (param_item (~nl~ ',' ~nl~ param_item)*)? ~nl~ ')' ~nl~)? block
condition <- '(' ~nl~ assignment_or_pipeline ~nl~ ')'
if <- ~k_if~ ~nl~ condition ~nl~ block (~nl~ ~k_elseif~ ~nl~ condition ~nl~ block)* (~nl~ ~k_else~ ~nl~ block)?
foreach <- ~k_foreach~ ~ws~ ~parallel~ '(' ~nl~ ~variable~ ~nl~ ~k_in~ ~nl~ assignment_or_pipeline ~nl~ ')' ~nl~ block
for <- ~k_for~ ~nl~ '(' ~nl~ assignment_or_pipeline? ~nl~ (';' ~nl~ assignment_or_pipeline? ~nl~)? (';' ~nl~ assignment_or_pipeline? ~nl~)? ')' ~nl~ block
while <- ~k_while~ ~nl~ condition ~nl~ block
do <- ~k_do~ ~nl~ block ~nl~ (~k_while~ / ~k_until~) ~nl~ condition
switch <- ~k_switch~ ~ws~ (~switch_flag~ ~ws~)* (condition / expression) ~nl~ '{' ~nl~ (switch_case ~semis~ ~nl~)* '}'
switch_case <- (block / expression / ~word~) ~nl~ block
try <- ~k_try~ ~nl~ block (~nl~ ~k_catch~ ~nl~ (~type_literal~ (~nl~ ',' ~nl~ ~type_literal~)* ~nl~)? block)* (~nl~ ~k_finally~ ~nl~ block)?
trap <- ~k_trap~ ~nl~ (~type_literal~ ~nl~)? block
class <- ~k_class~ ~ws1~ ~word~ (~nl~ ':' ~nl~ ~type_name~ (~nl~ ',' ~nl~ ~type_name~)*)? ~nl~ balanced
data <- ~k_data~ ~ws~ ~word~? ~nl~ block
balanced <- '{' (comment / string / ~not_brace~ / balanced)* '}'
comment <- ~block_comment~ / ~line_comment~
flow <- ~k_value_flow~ ~ws~ assignment_or_pipeline? / ~k_jump~ (~ws1~ (~word~ / ~variable~))?
assignment_or_pipeline <- target ~ws~ ~assign~ ~nl~ statement / pipeline
target <- ~type_literal~* primary (~ws~ ',' ~ws~ ~type_literal~* primary)*
pipeline <- element (~ws~ ~pipe~ ~nl~ command_or_expression)* ~ws~ ~background~ (~chain~ ~nl~ assignment_or_pipeline)?
element <- command_or_expression
command_or_expression <- expression_statement / command
expression_statement <- &~expression_start~ expression (~ws~ redirection)* &~pipeline_end~
command <- (~invoke~ ~ws~ (string / primary / ~command_word~) / ~command_word~) (argument_gap argument)* ~ws~
argument_gap <- ~ws1~ / &~open~
argument <- redirection / ~switch_parameter~ / ~splat~ / ~end_of_parameters~ / argument_list
argument_list <- argument_value (~ws~ ',' ~nl~ argument_value)*
argument_value <- here_string / (string / primary / sub) (~glued~ / member / sub / string / ~plain_variable~)* / ~argument_word~ (string / sub / ~plain_variable~ / ~glued~)* / block
redirection <- ~redirect_merge~ / ~redirect~ ~ws~ argument_value
expression <- joined (~ws~ ~binary~ ~nl~ joined)*
joined <- unary (~ws~ ',' ~nl~ unary)* / ',' ~nl~ unary
unary <- (~unary_op~ ~nl~)* (~type_literal~ ~nl~ unary / ~increment~ ~ws~ primary / primary ~increment~?)
primary <- atom (member / index)*
member <- ~dot_or_scope~ (~member_name~ / ~variable~ / string / paren) ('(' ~nl~ (expression (~nl~ ',' ~nl~ expression)*)? ~nl~ ')')?
index <- '[' ~nl~ expression ~nl~ ']'
atom <- ~number~ / here_string / string / ~variable~ / paren / sub / array / hash / block / ~type_literal~
paren <- '(' ~nl~ statement ~nl~ ')'
sub <- '$(' ~nl~ (statement terminator)* statement? ~nl~ ')'
array <- '@(' ~nl~ (statement terminator)* statement? ~nl~ ')'
hash <- '@{' ~nl~ (hash_pair (~hash_separator~ ~nl~ hash_pair)*)? ~semis~ ~nl~ '}'
hash_pair <- (expression / ~hash_word~) ~nl~ '=' ~nl~ statement
string <- ~single~ / '"' (~double_part~ / sub)* '"'
here_string <- ~here_single~ / ~here_double_open~ (~here_double_end~ / (!~here_double_end~ (sub / ~here_double_part~))+ ~here_double_end~)
"""


def _keyword(words: str) -> str:
    return rf"(?i:{words})(?![\w-])"


_SPACE = r"(?:[ \t\u00a0]|`\r?\n|<#[\s\S]*?#>)"

_parse = compile_grammar(
    GRAMMAR,
    "script",
    False,
    regexes={
        "bom": "\ufeff?",
        "end": r"\Z",
        "ws": rf"{_SPACE}*+",
        "ws1": rf"{_SPACE}++",
        "nl": rf"(?:{_SPACE}|[\r\n\f]|#[^\r\n]*)*+",
        "separator": r"(?:#[^\r\n]*)?(?:;|\r?\n|\r|\Z)|(?=[})])",
        "semis": rf"(?:{_SPACE}*+;)*",
        "to_line_end": r"[^\r\n]*",
        "block_comment": r"<#[\s\S]*?#>",
        "line_comment": r"#[^\r\n]*",
        "not_brace": r"[^{}\"'#<]|<(?!#)",
        "label": r":\w+[ \t]+",
        "variable": r"\$(?:(?:\w+:)?(?:\w+)|[$?^]|\{[^}\r\n]+\})|@\w+(?![\w({'\"])",
        "plain_variable": r"\$(?:(?:\w+:)?\w+|[$?^]|\{[^}\r\n]+\})",
        "type_name": r"[A-Za-z_][\w.+]*(?:\[[\w.,+\[\] ]*\])?(?:\[,*\])*",
        "type_literal": r"\[[ \t]*[A-Za-z_][\w.+]*(?:\[[\w.,+\[\] ]*\])?(?:\[,*\])*[ \t]*\]",
        "word": r"[A-Za-z_][\w-]*",
        "hash_word": r"[A-Za-z_0-9][\w.-]*",
        "function_name": r"(?:\w+:)?[A-Za-z_][\w.-]*",
        "member_name": r"[A-Za-z_]\w*",
        "dot_or_scope": r"\??\.(?![.\s])|::",
        "assign": r"(?:[-+*/%]|\?\?)?=(?!=)",
        "pipe": r"\|(?!\|)",
        "chain": r"(?:&&|\|\|)",
        "background": r"(?:&(?!&))?",
        "pipeline_end": rf"{_SPACE}*+(?:\Z|[|;\r\n)}}#]|&)",
        "invoke": r"&(?!&)|\.(?=[ \t$'\"(])",
        "open": r"[({\"'$@]",
        "increment": r"\+\+|--",
        "unary_op": r"(?i:-not|-bnot|-split|-join)(?![\w])|!|[-+](?![-+=\w])|[-+](?=\d|\$|\()",
        "binary": r"(?i:-(?:[ci]?(?:eq|ne|gt|ge|lt|le|like|notlike|match|notmatch|contains|notcontains|in|notin|replace|split)|is|isnot|as|and|or|xor|band|bor|bxor|shl|shr|join|f))(?![\w-])|\.\.|\?\?(?!=)|[-+*/%](?!=)",
        "expression_start": r"[\"'$@(\[{\d!+,-]|\.\d",
        "number": r"(?i:0x[0-9a-f]+|\d+(?:\.\d+)?(?:e[-+]?\d+)?|\.\d+(?:e[-+]?\d+)?)(?i:[dln]|kb|mb|gb|tb|pb)?(?![\w])",
        "single": r"'(?:[^']|'')*+'",
        "double_part": r"(?:[^\"`$]|``|`[\s\S]|\"\"|\$(?!\())++",
        "here_single": r"@'[ \t]*\r?\n(?:[\s\S]*?\r?\n)??'@",
        "here_double_open": r"@\"[ \t]*\r?\n",
        "here_double_end": r"(?<=\n)\"@",
        "here_double_part": r"(?:[^`$\n]|`[\s\S]|\$(?!\()|\n(?!\"@))+\n?|\n",
        "command_word": r"(?!(?i:if|else|elseif|foreach|for|while|do|until|switch|try|catch|finally|trap|function|filter|class|enum|param|begin|process|end|data|return|throw|break|continue|exit|in|using)(?![\w-]))[A-Za-z_%?\\/~.*][^\s(){}\"'`;,|&<>$@=\[\]:]*+(?::[\\/][^\s(){}\"'`;,|&<>$@=]*+)?(?![\[=])",
        "argument_word": r"(?![-](?i:[A-Za-z]))(?:[^\s(){}\"'`;,|&<>$@#=\[\]:]|`[^\r\n])(?:[^\s(){}\"'`;,|&<>$]|`[^\r\n])*+",
        "glued": r"(?:[^\s(){}\"'`;,|&<>$\[\]]|`[^\r\n])+",
        "switch_parameter": r"-[A-Za-z?_][\w-]*+:?",
        "end_of_parameters": r"--(?=\s)",
        "splat": r"@\w+(?![\w({'\"])",
        "redirect_merge": r"[1-6*]?>&[12]",
        "redirect": r"[1-6*]?>>?",
        "hash_separator": rf"{_SPACE}*+(?:#[^\r\n]*)?(?:;|\r?\n)",
        "parallel": r"(?i:-parallel[ \t]*)?",
        "switch_flag": r"(?i:-(?:regex|wildcard|exact|casesensitive|parallel|file))(?![\w])",
        "k_using": _keyword("using"),
        "k_param": _keyword("param"),
        "k_named_block": _keyword("begin|process|end|dynamicparam|clean"),
        "k_function": _keyword("function|filter|workflow|configuration"),
        "k_if": _keyword("if"),
        "k_elseif": _keyword("elseif"),
        "k_else": _keyword("else"),
        "k_foreach": _keyword("foreach"),
        "k_for": _keyword("for"),
        "k_in": _keyword("in"),
        "k_while": _keyword("while"),
        "k_until": _keyword("until"),
        "k_do": _keyword("do"),
        "k_switch": _keyword("switch"),
        "k_try": _keyword("try"),
        "k_catch": _keyword("catch"),
        "k_finally": _keyword("finally"),
        "k_trap": _keyword("trap"),
        "k_class": _keyword("class|enum"),
        "k_data": _keyword("data"),
        "k_value_flow": _keyword("return|throw|exit"),
        "k_jump": _keyword("break|continue"),
    },
)


def furthest_failure(text: str) -> int:
    """Offset of the furthest failure, or -1 if the whole text is valid."""
    end, far = _parse(text)
    return -1 if end == len(text) else far
