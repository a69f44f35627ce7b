"""A parsing-expression grammar for each source language (see ``peg`` for the notation)."""

from __future__ import annotations

from functools import cache

from .lexers import KEYWORDS
from .peg import Grammar

_CLASSES = ["NAME", "NUM", "STR", "CMD", "OBJ"]
_SIGNS = "<> <= >= != || :: -> ->> := - + * / % < > [ ] , . = : ? @ & | ^ ~ !".split()

PYTHON = r"""
file <- stmt* EOF
stmt <- compound / simple
-simple <- small (';' small)* ';'? NL
-block <- simple / NL+ INDENT stmt+ DEDENT
-compound <- 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
  / 'while' named ':' block ('else' ':' block)?
  / 'for' targets 'in' exprs ':' block ('else' ':' block)?
  / 'try' ':' block (('except' '*'? (exprs ('as' NAME)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? / 'finally' ':' block)
  / 'with' ('(' item (',' item)* ','? ')' &':' / item (',' item)*) ':' block
  / 'def' NAME typarams? '(' params? ')' ('->' expr)? ':' block
  / 'class' NAME typarams? ('(' args? ')')? ':' block
  / 'async' &('def' / 'for' / 'with') compound
  / '@' named NL (compound)
  / match
-match <- NAME exprs ':' NL INDENT (NAME exprs ('if' named)? ':' block)+ DEDENT
-item <- expr ('as' target)?
-typarams <- '[' typaram (',' typaram)* ','? ']'
-typaram <- ('*' / '**')? NAME (':' expr)? ('=' expr)?
params <- plist ','?
-plist <- plain (',' plain)* (',' '/')? (',' plain)* (',' given)* (',' '/')? (',' given)* (',' starpart)? / given (',' given)* (',' '/')? (',' given)* (',' starpart)? / starpart
-plain <- NAME (':' expr)? !'='
-given <- NAME (':' expr)? '=' expr
-starpart <- '*' NAME (':' starexpr)? (',' (given / plain))* (',' kwpart)? / '*' (',' (given / plain))+ (',' kwpart)? / kwpart
-kwpart <- '**' NAME (':' expr)?
small <- 'pass' / 'break' / 'continue'
  / 'return' exprs? / 'raise' (expr ('from' expr)?)?
  / 'global' NAME (',' NAME)* / 'nonlocal' NAME (',' NAME)*
  / 'del' deltarget (',' deltarget)* ','? / 'assert' expr (',' expr)?
  / 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)*
  / 'from' ('.' / '...')* dotted? 'import' ('*' / '(' alias (',' alias)* ','? ')' / alias (',' alias)*)
  / typealias / exprs !assigns / assignment
-assigns <- '=' / ':' / augmented
-typealias <- NAME NAME typarams? '=' expr
-alias <- NAME ('as' NAME)?
-dotted <- NAME ('.' NAME)*
-deltarget <- single / '(' (deltarget (',' deltarget)* ','?)? ')' / '[' (deltarget (',' deltarget)* ','?)? ']'
-assignment <- single ':' expr ('=' yielded)? / single augmented yielded / (lefts '=')+ yielded
-lefts <- targets &'='
-augmented <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
-yielded <- exprs
targets <- startarget ',' (startarget (',' startarget)* ','?)? / target
-startarget <- '*'? target
target <- single / '(' targets? ')' / '[' (startarget (',' startarget)* ','?)? ']'
single <- atom (!(lasttrailer !trailstart) trailer)* lasttrailer !trailstart / NAME !trailstart / '(' single ')' !trailstart
-lasttrailer <- '.' NAME / '[' subscript (',' subscript)* ','? ']'
-trailstart <- '.' / '(' / '['
exprs <- starexpr ',' (starexpr (',' starexpr)* ','?)? / named
starlist <- starexpr (',' starexpr)* ','?
-starexpr <- '*' or_bits / named
named <- NAME ':=' expr / expr
expr <- 'lambda' lparams? ':' expr / yieldexpr / disj ('if' disj 'else' expr)?
-yieldexpr <- 'yield' ('from' expr / exprs)?
-lparams <- llist ','?
-llist <- lplain (',' lplain)* (',' '/')? (',' lplain)* (',' lgiven)* (',' '/')? (',' lgiven)* (',' lstar)? / lgiven (',' lgiven)* (',' '/')? (',' lgiven)* (',' lstar)? / lstar
-lplain <- NAME !'='
-lgiven <- NAME '=' expr
-lstar <- '*' NAME (',' (lgiven / lplain))* (',' '**' NAME)? / '*' (',' (lgiven / lplain))+ (',' '**' NAME)? / '**' NAME
-disj <- conj ('or' conj)*
-conj <- inv ('and' inv)*
inv <- 'not' inv / or_bits (compare or_bits)*
-compare <- '==' / '!=' / '<=' / '>=' / '<' / '>' / 'in' / 'is' 'not'? / 'not' 'in'
or_bits <- unary (binary unary)*
-binary <- '+' / '-' / '*' / '/' / '//' / '%' / '@' / '**' / '|' / '&' / '^' / '<<' / '>>'
unary <- ('-' / '+' / '~')* 'await'? primary
primary <- atom trailer*
-trailer <- '.' NAME / '(' args? ')' / '[' subscript (',' subscript)* ','? ']'
-subscript <- expr? ':' expr? (':' expr?)? / starexpr
args <- named comp+ &')' / placed (',' placed)* (',' keyed)* (',' spread)* ','? / keyed (',' keyed)* (',' spread)* ','? / spread (',' spread)* ','?
-placed <- '*' expr / named !'='
-keyed <- NAME '=' expr / '*' expr
-spread <- NAME '=' expr / '**' expr
-comp <- 'async'? 'for' targets 'in' disj ('if' disj_noif)*
-disj_noif <- NAME ':=' expr / disj
atom <- NAME / NUM / (STR / fstring)+ / 'True' / 'False' / 'None' / '...'
  / '(' (named comp+ / exprs)? ')'
  / '[' (named comp+ / starlist)? ']'
  / '{' (pair comp+ / pair (',' pair)* ','? / named comp+ / starlist)? '}'
-pair <- '**' or_bits / expr ':' expr
-fstring <- 'FSTART' field* 'FEND'
-field <- 'F{' exprs '='? ('!' NAME)? ('F:' field*)? 'F}'
"""

_SCRIPT = r"""
file <- stmt* EOF
-eos <- ';' / &'}' / &EOF / %nl
-name <- NAME / CONTEXTUAL
block <- '{' stmt* '}'
stmt <- block / ';' / declaration / control / labelled / exprs eos
-labelled <- name ':' stmt
-declaration <- 'import' !('(' / '.') import eos / 'export' export / function / class / variables eos TSDECL
-import <- STR with? / TYPEONLY (name (',' (named / star))? / named / star) from with?
-with <- 'with' object
-from <- 'from' STR
-star <- '*' 'as' name
-named <- '{' (specifier (',' specifier)* ','?)? '}'
-specifier <- SPECTYPE (word / STR) ('as' (word / STR))?
-word <- name / RESERVED
-export <- 'default' (function / class / TSDEFAULT expr eos) / '*' ('as' (word / STR))? from eos / TYPEONLY named from? eos / function / class / variables eos TSEXPORT
function <- 'async'? 'function' '*'? name? TYPARAMS '(' (param (',' param)* ','?)? ')' RETURNTYPE (block SIGEND)
param <- DECORATORS MODIFIERS ('...' pattern OPTTYPE / pattern OPTTYPE ('=' expr)?)
pattern <- name THISPARAM / '[' (','* bound)? (',' bound?)* ']' / '{' (property (',' property)* ','?)? '}'
-bound <- '...' pattern / pattern ('=' expr)?
-property <- '...' name / key ':' pattern ('=' expr)? / name ('=' expr)?
-key <- word / STR / NUM / '[' expr ']'
class <- DECORATORS ABSTRACT 'class' (!('implements' '{') name)? TYPARAMS ('extends' unary TYARGS)? IMPLEMENTS '{' member* '}'
member <- ';' / 'static' block / DECORATORS MEMBERMODS (method / field eos)
-method <- ('async' &(key / '*'))? '*'? (('get' / 'set') &key)? key OPTMARK TYPARAMS '(' (param (',' param)* ','?)? ')' RETURNTYPE (block METHODEND)
-field <- key FIELDTYPE ('=' expr)? INDEXSIG
variables <- ('var' / 'let') declarator (',' declarator)* / 'const' ENUMNOT constant (',' constant)*
-declarator <- name BINDTYPE ('=' expr)? / pattern BINDTYPE '=' expr
-constant <- pattern BINDTYPE '=' expr
-control <- 'if' '(' exprs ')' stmt ('else' stmt)?
  / 'for' 'await'? '(' ( ('var' / 'const' / 'let') pattern ('in' / 'of') exprs / unary ('in' / 'of') exprs / (variables / exprs)? ';' exprs? ';' exprs? ) ')' stmt
  / 'while' '(' exprs ')' stmt / 'do' stmt 'while' '(' exprs ')' ';'?
  / 'continue' (!%nl name)? eos / 'break' (!%nl name)? eos / 'return' (!%nl exprs)? eos / 'throw' !%nl exprs eos
  / 'switch' '(' exprs ')' '{' (('case' exprs / 'default') ':' stmt*)* '}'
  / 'try' block ('catch' ('(' pattern OPTTYPE ')')? block ('finally' block)? / 'finally' block)
  / 'debugger' eos
exprs <- expr (',' expr)*
expr <- arrow / 'yield' !'=' ('*'? !%nl expr)? / conditional NOTBANG !assign / lvalue assign expr
lvalue <- primary (!(lasttail NONBANG &assign) tail)* lasttail NONBANG / lname
-lname <- (name / array / object) NONBANG &assign / '(' lvalue_in CASTS ')'
-lvalue_in <- primary (!(lasttail NONBANG castend) tail)* lasttail NONBANG / name / '(' lvalue_in CASTS ')'
-lasttail <- '.' word / '[' exprs ']'
-castend <- &(')' / CASTWORD)
-assign <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??=' / '>>>=' / '>' '>=' / '>' '>' '>='
arrow <- ('async' !'=>')? (name / TYPARAMS '(' (param (',' param)* ','?)? ')' RETURNTYPE) '=>' (block / expr)
conditional <- binary ('?' expr ':' expr)?
binary <- unary (operator unary CASTS)* CASTS (operator unary CASTS)*
-operator <- '||' / '&&' / '??' / '|' / '^' / '&' / '==' / '!=' / '===' / '!==' / '<=' / '>=' / 'instanceof' / 'in' / '<<' / '>' '>' '>' / '>' '>' / '>' / '<' / '+' / '-' / '*' / '/' / '%' / '**'
unary <- ('!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await' !('=' / ';' / ')' / '.' / '=>'))* postfix
postfix <- call (!%nl ('++' / '--'))?
call <- primary tail*
-tail <- '.' word / '?.' (word / '[' exprs ']' / args / STR)? / '[' exprs ']' / TYCALL args / STR / template NONNULL
-args <- '(' (arg (',' arg)* ','?)? ')'
-arg <- '...'? expr
primary <- function / class / 'new' ('.' NAME / newcall) / 'this' / 'super' / 'null' / 'true' / 'false' / NUM / STR / template / 'import' (args / '.' NAME)
  / '(' exprs ')' / array / object / name
-newcall <- 'new' newcall / primary ('.' word / '[' exprs ']')* TYARGS args?
template <- 'FSTART' ('F{' exprs 'F}')* 'FEND'
array <- '[' ','* (arg (',' arg?)*)? ']'
object <- '{' (member_of (',' member_of)* ','?)? '}'
-member_of <- '...' expr / key ':' expr / ('async' &(key / '*'))? '*'? (('get' / 'set') &key)? key TYPARAMS '(' (param (',' param)* ','?)? ')' RETURNTYPE block / name ('=' expr)?
"""
_RESERVED = " / ".join(f"'{w}'" for w in "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum let".split())
_SOFT_JS = "async of get set static from as await yield"
_SOFT_TS = _SOFT_JS + " type interface declare namespace module abstract readonly public private protected satisfies is asserts keyof infer override implements unique accessor"
_PLAIN = {
    "CONTEXTUAL": " / ".join(f"'{w}'" for w in _SOFT_JS.split()), "RESERVED": _RESERVED, "TSDECL": "", "TSEXPORT": "", "TSDEFAULT": "", "TYPEONLY": "", "SPECTYPE": "", "TYPARAMS": "", "RETURNTYPE": "", "SIGEND": "", "DECORATORS": "('@' call)*", "MODIFIERS": "",
    "OPTTYPE": "", "THISPARAM": "", "ABSTRACT": "", "TYARGS": "", "IMPLEMENTS": "", "MEMBERMODS": "('static' &(key / '*'))*", "OPTMARK": "", "METHODEND": "", "FIELDTYPE": "", "INDEXSIG": "", "BINDTYPE": "", "CASTS": "", "TYCALL": "", "NONNULL": "", "NONBANG": "", "NOTBANG": "", "CASTWORD": "')'", "ENUMNOT": "",
}
_TYPED = _PLAIN | {
    "CONTEXTUAL": " / ".join(f"'{w}'" for w in _SOFT_TS.split()), "TSDECL": "/ tsdecl", "TSEXPORT": "/ tsdecl / '=' exprs eos / 'as' 'namespace' name eos / 'import' name '=' exprs eos", "TSDEFAULT": "tsdecl /", "TYPEONLY": "('type' &(name !(',' / STR) / '{' / '*'))?", "SPECTYPE": "('type' &(word !','))?",
    "TYPARAMS": "typarams?", "RETURNTYPE": "(':' ('asserts' (name / 'this') ('is' type)? / (name / 'this') 'is' type / type))?", "SIGEND": "/ eos", "MODIFIERS": "(('public' / 'private' / 'protected' / 'readonly' / 'override') &(name / '[' / '{'))*", "OPTTYPE": "'?'? (':' type)?",
    "THISPARAM": "/ 'this'", "ABSTRACT": "'abstract'?", "TYARGS": "tyargs?", "IMPLEMENTS": "('implements' type (',' type)*)?", "MEMBERMODS": "(('static' / 'public' / 'private' / 'protected' / 'readonly' / 'override' / 'abstract' / 'declare' / 'accessor') &(key / '*'))*",
    "OPTMARK": "('?' / '!')?", "METHODEND": "/ eos", "FIELDTYPE": "('?' / '!')? (':' type)?", "INDEXSIG": "/ '[' name ':' type ']' ':' type", "BINDTYPE": "'!'? (':' type)?",
    "CASTS": "(!%nl ('as' / 'satisfies') ('const' / type))*", "TYCALL": "(tyargs &'(')?", "NONNULL": "/ !%nl '!' !'='", "NONBANG": "('!' &assign)?", "NOTBANG": "!('!' '=')", "CASTWORD": "'as' / 'satisfies'", "ENUMNOT": "!'enum'",
}
_TYPES = r"""
typarams <- '<' typaram (',' typaram)* ','? '>'
-typaram <- ('const' / 'in' / 'out')? name ('extends' type)? ('=' type)?
tyargs <- '<' type (',' type)* ','? '>'
type <- '|'? unite ('extends' type '?' type ':' type)?
-unite <- '&'? posttype (('|' / '&') '&'? posttype)*
-posttype <- ('keyof' / 'infer' / 'readonly' / 'unique' / 'abstract') &(name / '{' / '(' / '[' / 'typeof') posttype / 'typeof' ('import' '(' type ')' / name / 'this') ('.' word)* tyargs? (!%nl '[' type? ']')* / basetype (!%nl '[' type? ']')*
basetype <- 'new'? typarams? '(' (param (',' param)* ','?)? ')' '=>' type / '(' type ')' / '[' (tupleitem (',' tupleitem)* ','?)? ']'
  / '{' (tmember (';' / ',' / &'}' / %nl))* '}' / STR / 'FSTART' ('F{' type 'F}')* 'FEND' / '-'? NUM / 'void' / 'null' / 'true' / 'false' / 'this' / 'import' args ('.' word)* tyargs? / name ('.' word)* tyargs?
-tupleitem <- '...'? (name '?'? ':')? type '?'?
-signature <- typarams? '(' (param (',' param)* ','?)? ')' RETURNTYPE_
-tmember <- 'new'? signature / (('-' / '+')? 'readonly' &(key / '['))? ('[' name (':' / 'in') type ('as' type)? ']' (('-' / '+')? '?')? ':' type / (('get' / 'set') &key)? key '?'? (signature / (':' type)?))
-RETURN_RULE
tsdecl <- 'interface' name typarams? ('extends' type (',' type)*)? '{' (tmember (';' / ',' / &'}' / %nl))* '}' / 'type' !%nl name typarams? '=' type eos / ('namespace' / 'module') (STR / name ('.' name)*) block
  / 'const'? 'enum' name '{' (key ('=' expr)? (',' key ('=' expr)?)* ','?)? '}' / 'declare' (function / class / ambient eos / ('namespace' / 'module') (STR / name ('.' name)*) (ablock / eos) / tsdecl / name ablock) / 'abstract' class / 'import' name '=' exprs eos
-ambient <- ('var' / 'const' / 'let') !'enum' pattern (':' type)? ('=' expr)? (',' pattern (':' type)? ('=' expr)?)*
-ablock <- '{' ('export'? ambient eos / stmt)* '}'
"""
_TYPES = _TYPES.replace("-RETURN_RULE\n", "").replace("RETURNTYPE_", _TYPED["RETURNTYPE"])


def _script(fill: dict[str, str], extra: str = "") -> str:
    import re

    return re.sub("|".join(sorted(map(re.escape, fill), key=len, reverse=True)), lambda m: fill[m.group()], _SCRIPT) + extra


_BRACE_BINARY = "'||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' '>' / '>' '>' / '<' / '>' / '+' / '-' / '*' / '/' / '%'"
_ASSIGN = "'=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<='"

JAVA = rf"""
file <- (annotations 'package' dotted ';')? import* (moduledecl / (type_decl / ';' / toplevel)*) EOF
-moduledecl <- annotations (NAME &(NAME NAME))? NAME dotted '{{' (NAME ((NAME / 'static') &NAME)? dotted ((NAME / 'to' / 'with') dotted (',' dotted)*)? ';')* '}}'
-toplevel <- mods typarams? ('void' / type) NAME '(' params? ')' throws? block / mods type vars ';'
-import <- 'import' 'static'? NAME ('.' NAME)* ('.' '*')? ';' / ';'
-dotted <- NAME ('.' NAME)*
-annotations <- annotation*
annotation <- '@' !'interface' dotted ('(' ((NAME '=' element) (',' NAME '=' element)* / element)? ')')?
-element <- annotation / '{{' (element (',' element)*)? ','? '}}' / expr
-mods <- (annotation / 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !':' / NAME &('class' / 'interface' / NAME ('class' / 'interface')))*
type_decl <- mods (class / interface / enum / record / '@' 'interface' NAME '{{' member* '}}')
-class <- 'class' NAME typarams? ('extends' type)? ('implements' types)? (NAME types)? body
-interface <- 'interface' NAME typarams? ('extends' types)? (NAME types)? body
-enum <- 'enum' NAME ('implements' types)? '{{' (constant (',' constant)*)? ','? (';' member*)? '}}'
-constant <- annotations NAME args? body?
-record <- NAME NAME typarams? '(' params? ')' ('implements' types)? body
-types <- type (',' type)*
body <- '{{' member* '}}'
member <- ';' / 'static'? block / mods (class / interface / enum / '@' 'interface' NAME body / typarams? NAME '(' params? ')' throws? block / typarams? ('void' / type) NAME '(' params? ')' dims throws? (block / ('default' element)? ';') / type vars ';' / record / NAME block)
-throws <- 'throws' types
-typarams <- '<' typaram (',' typaram)* '>'
-typaram <- annotations NAME ('extends' type ('&' type)*)?
type <- annotations (primitive / NAME tyargs? ('.' NAME tyargs?)*) (annotations '[' ']')*
-primitive <- 'boolean' / 'byte' / 'char' / 'double' / 'float' / 'int' / 'long' / 'short'
tyargs <- '<' (tyarg (',' tyarg)*)? '>'
-tyarg <- '?' (('extends' / 'super') type)? / type
-params <- param (',' param)*
-param <- mods type '...'? ('this' / NAME) dims
-dims <- ('[' ']')*
-vars <- var (',' var)*
-var <- NAME dims ('=' (expr / arrayinit))?
arrayinit <- '{{' ((expr / arrayinit) (',' (expr / arrayinit))*)? ','? '}}'
block <- '{{' stmt* '}}'
stmt <- block / ';' / 'if' '(' expr ')' stmt ('else' stmt)? / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';'
  / 'for' '(' (mods type NAME ':' expr / (mods type vars / exprs)? ';' expr? ';' exprs?) ')' stmt
  / 'return' expr? ';' / 'break' NAME? ';' / 'continue' NAME? ';' / 'throw' expr ';'
  / 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' mods type ('|' type)* NAME ')' block)* ('finally' block)?
  / switch / 'synchronized' '(' expr ')' block / 'assert' expr (':' expr)? ';'
  / NAME ':' stmt / mods (class / interface / enum) / mods type vars ';' / record / 'yield' expr ';' / stmtexpr ';'
stmtexpr <- lvalue assignop expr / ('++' / '--') unary / switch / callchain &(';' / ',' / ')') / primary tail* ('++' / '--')
-assignop <- {_ASSIGN} / '>>=' / '>' '>>=' / '>' '>=' / '>' '>' '>='
lvalue <- primary (!(lasttail &assignop) tail)* lasttail &assignop / NAME &assignop / '(' lvalue_in ')'
-lvalue_in <- primary (!(lasttail ')') tail)* lasttail / NAME / '(' lvalue_in ')'
-lasttail <- '.' NAME !'(' / '[' expr ']'
-callchain <- primary (!(lastcall &(';' / ',' / ')')) tail)* lastcall / new !tailstart / NAME args !tailstart / ('this' / 'super') args !tailstart
-lastcall <- '.' tyargs? NAME args / '.' 'super' args / '.' 'new' NAME tyargs? args body? / '.' tyargs 'super' args
-tailstart <- '.' / '[' / '::'
-resource <- mods type NAME '=' expr / expr
switch <- 'switch' '(' expr ')' '{{' (('case' label (',' label)* guard? / 'default') (':' stmt* / '->' (block / 'throw' expr ';' / expr ';')))* '}}'
-label <- 'default' / recordpat / mods type NAME / cond
-recordpat <- type '(' (subpat (',' subpat)*)? ')' NAME?
-subpat <- recordpat / mods type NAME
-guard <- NAME expr
exprs <- expr (',' expr)*
expr <- lambda / cond !assignop / lvalue assignop expr
-lambda <- (NAME / '(' (NAME (',' NAME)* / params)? ')') '->' (block / expr)
cond <- binary ('?' expr ':' expr)?
binary <- unary ('instanceof' mods type NAME? ('(' params? ')')? / ({_BRACE_BINARY}) unary)*
unary <- ('!' / '~' / '+' / '-' / '++' / '--')* (cast / postfix)
-cast <- '(' primitive dims ')' unary / '(' type ('&' type)* ')' (lambda / &('!' / '~' / '(' / NAME / NUM / STR / 'this' / 'super' / 'new' / 'true' / 'false' / 'null' / 'switch') unary)
postfix <- primary tail* ('++' / '--')*
-tail <- '.' (tyargs? NAME args? / 'this' / 'class' / 'super' args? / 'new' NAME tyargs? args body? / tyargs 'super' args) / '[' expr ']' / '::' (NAME / 'new')
primary <- NUM / STR / 'true' / 'false' / 'null' / 'this' args? / 'super' args? / '(' expr ')' / new / switch / type ('::' 'new' / '::' NAME / '.' 'class') / ('void') '.' 'class' / NAME args?
-new <- 'new' type_noarr (args body? / ('[' expr ']')+ ('[' ']')* / ('[' ']')+ arrayinit)
-type_noarr <- annotations (primitive / NAME tyargs? ('.' NAME tyargs?)*)
-args <- '(' exprs? ')'
"""

CSHARP = rf"""
file <- (extern / using)* attrs_global* namespace_line? (decl / stmt)* EOF
-extern <- 'extern' NAME NAME ';'
-using <- NAME? 'using' 'static'? 'unsafe'? (NAME '=')? type ';'
-attrs_global <- '[' NAME ':' attr (',' attr)* ']'
-namespace_line <- 'namespace' dotted ';' using*
-dotted <- NAME ('.' NAME)*
decl <- ';' / 'namespace' dotted '{{' using* decl* '}}' ';'? / attrs mods type_decl
-attrs <- ('[' (NAME ':' / 'return' ':')? attr (',' attr)* ','? ']')*
-attr <- type ('(' args? ')')?
-mods <- ('public' / 'private' / 'protected' / 'internal' / 'static' / 'readonly' / 'abstract' / 'sealed' / 'virtual' / 'override' / 'extern' / 'unsafe' / 'volatile' / 'new' / 'const' / 'ref' / 'fixed' / 'async' / 'partial')*
-type_decl <- ('class' / 'struct' / 'interface' / NAME ('class' / 'struct')?) NAME typarams? ('(' params? ')')? (':' type ('(' args? ')')? (',' type)*)? wheres (body / ';') ';'? / 'enum' NAME (':' type)? '{{' (attrs NAME ('=' expr)? (',' attrs NAME ('=' expr)?)* ','?)? '}}' ';'? / 'delegate' ref_type NAME typarams? '(' params? ')' wheres ';'
-wheres <- (NAME NAME ':' constraint (',' constraint)*)*
-constraint <- 'class' '?'? / 'struct' / 'new' '(' ')' / 'default' / type
-typarams <- '<' attrs ('in' / 'out')? NAME (',' attrs ('in' / 'out')? NAME)* '>'
body <- '{{' member* '}}'
member <- ';' / attrs modset (type_decl / '~'? NAME '(' params? ')' (':' ('base' / 'this') '(' args? ')')? tailbody
  / 'event' type (NAME (',' NAME)* ('=' expr)? ';' / membername accessors) / ('implicit' / 'explicit') 'operator' type '(' params ')' tailbody
  / ref_type 'operator' ('true' / 'false' / '!' / '~' / '++' / '--' / '==' / '!=' / binop) '(' params ')' tailbody
  / ref_type (type '.')? 'this' '[' params ']' (accessors / '=>' expr ';')
  / ref_type membername (typarams? '(' params? ')' wheres tailbody / accessors ('=' expr ';')? / '=>' expr ';' / ('=' (expr / init))? (',' NAME ('=' (expr / init))?)* ';'))
-modset <- ('public' / 'private' / 'protected' / 'internal' / 'static' / 'readonly' / 'abstract' / 'sealed' / 'virtual' / 'override' / 'extern' / 'unsafe' / 'volatile' / 'new' / 'const' / 'fixed' / 'async' / 'partial' / NAME &('public' / 'private' / 'protected' / 'internal' / 'static' / 'readonly' / ref_type membername ('{{' / ';' / '=')))*
-membername <- NAME typarams? ('.' NAME typarams?)*
-ref_type <- 'void' '*'* / 'ref' 'readonly'? type / type
-accessors <- '{{' (attrs ('public' / 'private' / 'protected' / 'internal' / 'readonly')* NAME (';' / block / '=>' expr ';'))+ '}}'
-tailbody <- block / '=>' expr ';' / ';'
-params <- param (',' param)*
-param <- attrs ('this' / 'ref' / 'out' / 'in' / 'params' / 'readonly' / NAME &(NAME NAME))* type NAME ('=' expr)? / '__arglist'
type <- (prim / 'void' '*' / '(' type NAME? (',' type NAME?)+ ')' / NAME ('::' NAME)? tyargs? ('.' NAME tyargs?)*) ('?' !(expr ':') / '*' &('*' / NAME / ')' / '>' / ',') / '[' ','* ']')*
-prim <- 'bool' / 'byte' / 'char' / 'decimal' / 'double' / 'float' / 'int' / 'long' / 'object' / 'sbyte' / 'short' / 'string' / 'uint' / 'ulong' / 'ushort'
tyargs <- '<' (type? (',' type?)*) '>'
block <- '{{' stmt* '}}'
stmt <- block / ';' / 'if' '(' expr ')' stmt ('else' stmt)? / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';'
  / 'for' '(' (local / exprs)? ';' expr? ';' exprs? ')' stmt / 'await'? 'foreach' '(' (type / NAME) (NAME / '(' NAME (',' NAME)* ')') 'in' expr ')' stmt
  / 'return' ('ref'? expr)? ';' / 'break' ';' / 'continue' ';' / 'goto' ('case' expr / 'default' / NAME) ';' / 'throw' expr? ';'
  / 'try' block ('catch' ('(' type NAME? ')')? (NAME '(' expr ')')? block)* ('finally' block)?
  / 'switch' '(' expr ')' '{{' ((('case' casepat (NAME expr)? / 'default') ':')+ stmt+)* '}}'
  / 'await'? 'using' ('(' (local / expr) ')' stmt / local ';') / 'lock' '(' expr ')' stmt / ('checked' / 'unchecked' / 'unsafe') block / 'fixed' '(' local ')' stmt
  / NAME ':' stmt / 'const' local ';' / localfn / local ';' / NAME ('return' expr? / 'break') ';' / stmtexpr ';'
stmtexpr <- lvalue assignop ('ref'? expr) / ('++' / '--') unary / 'await'+ unary / callchain &(';' / ',' / ')') / primary tail* ('++' / '--') / new !tailstart / '(' stmtexpr ')' / 'throw' expr
-assignop <- {_ASSIGN} / '??=' / '>' '>' '>' '>=' / '>' '>' '>=' / '>' '>='
lvalue <- primary (!(lasttail &assignop) tail)* lasttail &assignop / deconstruct &assignop / NAME &assignop / '*' unary &assignop
-deconstruct <- '(' decon (',' decon)+ ')' / NAME '(' NAME (',' NAME)* ')'
-decon <- deconstruct / type NAME / (primary tail*)
-lasttail <- ('.' / '?.' / '->' / '::') NAME tyargs_call? !'(' / '?'? '[' arglist ']'
-callchain <- primary ('!'? !(lastcall '!'? &(';' / ',' / ')')) tail)* '!'? lastcall '!'?
-lastcall <- '(' args? ')'
-tailstart <- '.' / '?.' / '['
-localfn <- attrs ('static' / 'unsafe' / 'extern' / 'async')* ref_type NAME typarams? '(' params? ')' wheres tailbody
-local <- ('ref' 'readonly'?)? type NAME ('=' ('ref'? expr / init))? (',' NAME ('=' (expr / init))?)*
init <- '{{' ((expr / init) (',' (expr / init))*)? ','? '}}'
-casepat <- pattern
pattern <- pat1 (NAME pat1)*
-pat1 <- '[' (slice (',' slice)* ','?)? ']' NAME? / NAME pat1 / ('<=' / '>=' / '<' / '>') binary / '(' pattern ')' / type NAME / type? '{{' (NAME ('.' NAME)* ':' pattern (',' NAME ('.' NAME)* ':' pattern)* ','?)? '}}' NAME? / type '(' (pattern (',' pattern)*)? ')' NAME? / binary
-slice <- '..' pattern? / pattern
exprs <- expr (',' expr)*
expr <- query / lambda / cond !assignop / lvalue assignop ('ref'? expr) / 'throw' expr
query <- NAME (type &NAME)? NAME 'in' expr clause+
-clause <- NAME (type &NAME)? NAME 'in' expr (NAME expr NAME expr (NAME NAME)?)? / NAME NAME '=' expr / NAME NAME &clause / NAME expr NAME? (',' expr NAME?)* (NAME expr (NAME NAME)?)?
-lambda <- ('static' / 'async')* (NAME / '(' (params / NAME (',' NAME)*)? ')') '=>' (block / 'ref'? expr) / NAME? 'delegate' ('(' params? ')')? block
cond <- binary ('?' expr ':' expr)?
binary <- unary ('is' 'not'? pattern / 'as' type / 'switch' '{{' (pattern (NAME expr)? '=>' expr (',' pattern (NAME expr)? '=>' expr)* ','?)? '}}' / NAME '{{' inits '}}' / binop unary)*
-binop <- '??' / '..' / {_BRACE_BINARY}
unary <- ('!' / '~' / '+' / '-' / '++' / '--' / '&' / '*' / '^' / 'await')* (cast / postfix)
-cast <- '(' prim ('?' / '[' ']')* ')' unary / '(' type ')' &('!' / '~' / '(' / NAME / NUM / STR / 'this' / 'new' / 'base' / 'null' / 'true' / 'false' / 'default' / 'typeof' / prim) unary
postfix <- primary tail* ('++' / '--' / '!')* tail*
-tail <- ('.' / '?.' / '->' / '::') NAME tyargs_call? / '?'? '[' arglist ']' / '(' args? ')'
-tyargs_call <- tyargs &('(' / ')' / ';' / '.' / ',')
-arglist <- arg (',' arg)*
args <- arg (',' arg)*
-arg <- (NAME ':')? ('ref' expr / 'out' (type NAME / expr) / 'in' expr / expr)
primary <- NUM / (STR / interpolated)+ / 'true' / 'false' / 'null' / 'this' / 'base' / '(' expr (',' expr)* ')' / '(' (NAME ':')? expr (',' (NAME ':')? expr)* ')' / new / 'typeof' '(' ('void' / type) ')' / 'sizeof' '(' type ')' / 'default' ('(' type ')')? / ('checked' / 'unchecked') '(' expr ')' / 'stackalloc' type init? / '[' (('..'? expr) (',' '..'? expr)*)? ','? ']' / prim / NAME tyargs_call?
-new <- 'new' ('(' args? ')' objinit? / '[' ','* ']' init / objinit / newtype (('[' exprs ']' ('[' ','* ']')* / '[' ','* ']') init? / '(' args? ')' objinit? / objinit))
-newtype <- (prim / NAME ('::' NAME)? tyargs? ('.' NAME tyargs?)*) '?'?
-interpolated <- 'FSTART' ('F{{' expr (',' expr)? 'F:'? 'F}}')* 'FEND'
-objinit <- '{{' inits '}}'
-inits <- (initm (',' initm)* ','?)?
-initm <- (NAME / '[' exprs ']') '=' (objinit / expr) / objinit / expr
"""

C = rf"""
file <- (external)* EOF
external <- ';' / staticassert / asm ';' / 'extern' STR ('{{' external* '}}' / external) / function / declaration
function <- specs declarator declaration* block
declaration <- specs (initdecl (',' initdecl)*)? ';'
specs <- (storage)* typespec (storage / builtin)* attribute*
-storage <- '_Alignas' '(' (typename / cond) ')' / 'typedef' / 'extern' / 'static' / 'auto' / 'register' / 'inline' / 'const' / 'volatile' / 'restrict' / attribute
-staticassert <- ('_Static_assert' / 'static_assert') '(' cond (',' STR+)? ')' ';'
-asm <- ('asm' / '__asm__' / '__asm') ('volatile' / 'goto' / 'inline' / NAME)* '(' (asmpart)* ')'
-asmpart <- '(' asmpart* ')' / '[' asmpart* ']' / !(')' / ']') !EOF (NAME / NUM / STR / ':' / ',' / '=' / '+' / '-' / '*' / '&' / '.' / '->' / '%' / '#' / '|' / '<' / '>' / '(' / 'sizeof')
-attribute <- ATTR / NAME '(' '(' balanced* ')' ')'
-balanced <- '(' balanced* ')' / !')' !EOF ANY_TOKEN
typespec <- builtin+ / ('struct' / 'union') attribute* (NAME? '{{' (field / ';')* '}}' / NAME) / 'enum' (NAME? '{{' enumerator (',' enumerator)* ','? '}}' / NAME) / NAME
-builtin <- 'void' / 'char' / 'short' / 'int' / 'long' / 'float' / 'double' / 'signed' / 'unsigned' / 'const' / 'volatile' / '_Complex'
-enumerator <- NAME ('=' cond)?
field <- staticassert / specs (fdecl (',' fdecl)*)? ';'
-fdecl <- declarator (':' cond)? / ':' cond
-initdecl <- declarator ('=' init)?
init <- '{{' (initem (',' initem)*)? ','? '}}' / expr
-initem <- (('.' NAME / '[' cond ('...' cond)? ']')+ '=')? init
declarator <- pointer* (NAME / '(' attribute* declarator ')') suffix* attribute*
-pointer <- '*' ('const' / 'volatile' / 'restrict')*
-suffix <- '[' ('static' / 'const' / 'restrict' / 'volatile')* (expr / '*')? ']' / '(' (params / NAME (',' NAME)*)? ')'
params <- param (',' param)* (',' '...')?
-param <- specs (declarator / abstract)?
abstract <- pointer+ (('(' abstract ')') suffix* / suffix*) / '(' abstract ')' suffix* / suffix+
typename <- specs abstract?
block <- '{{' (stmt)* '}}'
stmt <- block / ';' / 'if' '(' exprs ')' stmt ('else' stmt)? / 'while' '(' exprs ')' stmt / 'do' stmt 'while' '(' exprs ')' ';'
  / 'for' '(' (declaration / exprs? ';') exprs? ';' exprs? ')' stmt / 'switch' '(' exprs ')' stmt
  / 'case' cond ('...' cond)? ':' stmt? / 'default' ':' stmt? / 'return' exprs? ';' / 'break' ';' / 'continue' ';' / 'goto' NAME ';'
  / NAME ':' stmt? / staticassert / asm ';' / declaration / exprs ';'
exprs <- expr (',' expr)*
expr <- cond (({_ASSIGN} / '>>=') expr)?
cond <- binary ('?' exprs? ':' cond)?
binary <- unary (('>>' / {_BRACE_BINARY}) unary)*
unary <- ('!' / '~' / '+' / '-' / '++' / '--' / '&' / '*' / '&&')* ('sizeof' ('(' typename ')' / unary) / cast / postfix)
-cast <- '(' typename ')' ('{{' (initem (',' initem)*)? ','? '}}' postop* / unary)
postfix <- primary postop*
-postop <- '[' exprs ']' / '(' (carg (',' carg)*)? ')' / '.' NAME / '->' NAME / '++' / '--'
-carg <- expr / typename
primary <- '_Generic' '(' expr (',' ('default' / typename) ':' expr)+ ')' / '_Alignof' '(' typename ')' / NAME / NUM / (STR / NAME &STR)+ NAME? / '(' block ')' / '(' exprs ')'
"""
C = C.replace("ATTR / ", "").replace("ANY_TOKEN", "(NAME / NUM / STR / ',' / '=' / '.' / ';' / '*')")

GO = rf"""
file <- 'package' NAME ';' (import ';')* (toplevel ';')* EOF
-import <- 'import' (importspec / '(' (importspec ';')* importspec? ')')
-importspec <- (NAME / '.')? STR
toplevel <- 'func' receiver? NAME typarams? signature block? / decl
-receiver <- '(' NAME? '*'? type ','? ')'
-typarams <- '[' NAME (',' NAME)* constraint (',' NAME (',' NAME)* constraint)* ','? ']'
-constraint <- '~'? type ('|' '~'? type)*
decl <- 'var' (varspec / '(' (varspec ';')* varspec? ')') / 'const' (constspec / '(' (constspec ';')* constspec? ')') / 'type' (typespec / '(' (typespec ';')* typespec? ')')
-varspec <- names (type ('=' exprs)? / '=' exprs)
-constspec <- names (type? '=' exprs)?
-typespec <- NAME typarams '='? type / NAME '='? type
-names <- NAME (',' NAME)*
signature <- params result?
-result <- params / type
params <- '(' (param (',' param)* ','?)? ')'
-param <- NAME '...' type / NAME type / '...' type / type
type <- '*' type / '[' ('...' / expr)? ']' type / 'map' '[' type ']' type / 'chan' '<-'? type / '<-' 'chan' type / 'func' signature
  / 'struct' '{{' (field ';')* field? '}}' / 'interface' '{{' (imember ';')* imember? '}}' / '(' type ')' / NAME ('.' NAME)? ('[' type (',' type)* ']')?
-field <- ('*'? NAME ('.' NAME)? ('[' type ']')? STR? &(';' / '}}') / names type STR?)
-imember <- NAME signature / constraint
block <- '{{' (stmt ';')* stmt? '}}'
stmt <- decl / 'return' exprs? / 'break' NAME? / 'continue' NAME? / 'goto' NAME / 'fallthrough' / ('defer' / 'go') gocall
  / if / for / switch / 'select' '{{' (('case' simple / 'default') ':' (stmt ';')* stmt?)* '}}' / block / NAME ':' !'=' (stmt)? / simple / EMPTY
-if <- 'if' (simple_h? ';')? simple_h block ('else' (if / block))?
-for <- 'for' ( (exprs_h ('=' / ':='))? 'range' expr_h / simple_h? ';' expr_h? ';' simple_h? / expr_h )? block
-switch <- 'switch' (simple_h? ';' &(NAME / '{{' / NUM / STR / '(' / '&' / '*' / '!' / '-'))? simple_h? '{{' (('case' (types / exprs) / 'default') ':' (stmt ';')* stmt?)* '}}'
-types <- type (',' type)*
-gocall <- operand (!('(' callargs? ')' &(';' / '}}')) tail)* '(' callargs? ')'
simple <- lhs (('=' / ':=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^=') ('range' expr / exprs)) / exprs ('++' / '--' / '<-' expr)?
-lhs <- unary (',' unary)*
-lhs_h <- unary_h (',' unary_h)*
simple_h <- lhs_h (('=' / ':=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^=') exprs_h) / exprs_h ('++' / '--' / '<-' expr_h)?
exprs <- expr (',' expr)*
exprs_h <- expr_h (',' expr_h)*
expr <- unary (binop unary)*
expr_h <- unary_h (binop unary_h)*
-binop <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&' / '&^'
-prefix <- ('!' / '-' / '+' / '^' / '*' / '&' / '<-')*
unary <- prefix primary
unary_h <- prefix primary_h
primary <- (literal / operand) tail*
primary_h <- operand tail_h*
-tail <- '.' (NAME / '(' ('type' / type) ')') / '[' index ']' / '(' callargs? ')' / litbody
-tail_h <- '.' (NAME / '(' ('type' / type) ')') / '[' index ']' / '(' callargs? ')'
-index <- expr? ':' expr? (':' expr?)? / (expr / type) (',' (expr / type))* ','?
-callargs <- callarg (',' callarg)* '...'? ','?
-callarg <- expr / type
operand <- NUM / STR / NAME / '(' (expr / type) ')' / 'func' signature block / typelit
-typelit <- &('[' / 'map' / 'chan' / 'struct' / 'interface') type (litbody / '(' expr ')')
literal <- NAME ('.' NAME)? ('[' type (',' type)* ']')? litbody
litbody <- '{{' (elem (',' elem)* ','?)? '}}'
-elem <- (expr / litbody) (':' (expr / litbody))?
"""
GO = GO.replace(" / EMPTY", "")

RUST = rf"""
file <- inner* item* EOF
-inner <- '#' '!' '[' tokens* ']'
-attr <- '#' '[' tokens* ']'
tokens <- '(' tokens* ')' / '[' tokens* ']' / '{{' tokens* '}}' / !(')' / ']' / '}}' / EOF / BAD) any
-any <- NAME / NUM / STR / ANYWORD / '<<=' / '...' / '..=' / '::' / '->' / '=>' / '&&' / '||' / '==' / '!=' / '<=' / '>=' / '..' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<' / '-' / '+' / '*' / '/' / '%' / '&' / '|' / '^' / '~' / '<' / '>' / ',' / ':' / '.' / ';' / '=' / '!' / '?' / '@' / '#' / '$'
-vis <- ('pub' ('(' ('crate' / 'self' / 'super' / 'in' path) ')')?)?
item <- attr* (vis (use / module / function / struct / enum / union / trait / impl / constant / typealias / externblock) / macro (';' / &NAME / !';' ) / ';')
-use <- 'use' usetree ';'
usetree <- '::'? ((NAME / 'crate' / 'self' / 'super' / 'Self') '::')* ('*' / '{{' (usetree (',' usetree)* ','?)? '}}' / (NAME / 'crate' / 'self' / 'super') ('as' NAME)?)
-module <- 'unsafe'? 'mod' NAME (';' / '{{' inner* item* '}}')
function <- ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' NAME generics? '(' (fnparam (',' fnparam)* ','?)? ')' ('->' type)? where? (block / ';')
-fnparam <- attr* ('&' lifetime? 'mut'? 'self' / 'mut'? 'self' (':' type)? / pattern ':' type / '...')
-lifetime <- NAME
-struct <- 'struct' NAME generics? (where? '{{' (sfield (',' sfield)* ','?)? '}}' / '(' (attr* vis type (',' attr* vis type)* ','?)? ')' where? ';' / where? ';')
-sfield <- attr* vis NAME ':' type
-union <- NAME NAME generics? where? '{{' (sfield (',' sfield)* ','?)? '}}'
-enum <- 'enum' NAME generics? where? '{{' (variant (',' variant)* ','?)? '}}'
-variant <- attr* vis NAME ('{{' (sfield (',' sfield)* ','?)? '}}' / '(' (attr* vis type (',' attr* vis type)* ','?)? ')')? ('=' expr)?
-trait <- 'unsafe'? NAME? 'trait' NAME generics? (':' bounds)? where? '{{' inner* item* '}}'
-impl <- 'unsafe'? 'impl' generics? 'const'? '!'? type ('for' type)? where? '{{' inner* item* '}}'
-constant <- ('const' / 'static' 'mut'?) NAME ':' type ('=' expr)? ';'
-typealias <- 'type' NAME generics? (':' bounds)? where? ('=' type)? where? ';'
-externblock <- 'unsafe'? 'extern' (STR? '{{' inner* item* '}}' / 'crate' (NAME / 'self') ('as' NAME)? ';')
-macro <- path '!' NAME? ('(' tokens* ')' / '[' tokens* ']' / '{{' tokens* '}}')
-generics <- '<' (gparam (',' gparam)* ','?)? '>'
-gparam <- attr* ('const' NAME ':' type ('=' (expr_block / NUM / NAME))? / NAME (':' bounds?)? ('=' type)?)
-expr_block <- block
-where <- 'where' (wpred (',' wpred)* ','?)?
-wpred <- hrtb? type ':' bounds?
-hrtb <- 'for' generics
bounds <- bound ('+' bound)* '+'?
-bound <- '?'? '~'? 'const'? hrtb? (path / '(' bound ')')
type <- '!' / '(' (type (',' type)* ','?)? ')' / '[' type (';' expr)? ']' / ('&' / '&&') lifetime_t? 'mut'? type_nb / '*' ('const' / 'mut') type_nb
  / hrtb? ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' '(' ((NAME ':')? type (',' (NAME ':')? type)* ','? '...'?)? ')' ('->' type_nb)? / ('impl' / 'dyn') bounds / macro / path ('+' bounds)?
-type_nb <- 'dyn' bound / type
-lifetime_t <- NAME &('mut' / NAME / '[' / '(' / 'dyn' / 'Self' / '&' / 'crate' / 'self' / 'impl' / '*')
path <- qualified / '::'? segment ('::' segment)*
-qualified <- '<' type ('as' path)? '>' ('::' segment)+
-segment <- (NAME / 'self' / 'Self' / 'super' / 'crate') ('::'? targs / '(' (type (',' type)* ','?)? ')' ('->' type_nb)?)?
targs <- '<' (targ (',' targ)* ','?)? '>'
-targ <- NAME targs? ('=' / ':' ) (type / bounds) / type / block / '-'? NUM / STR / 'true' / 'false'
epath <- qualified / '::'? esegment ('::' esegment)*
-esegment <- (NAME / 'self' / 'Self' / 'super' / 'crate') ('::' targs)?
block <- '{{' inner* stmt* blockend? '}}'
-blockend <- expr
stmt <- ';' / attr* (let / &('use' / 'fn' / 'struct' / 'enum' / 'trait' / 'impl' / 'static' / 'mod' / 'type' / 'extern' / 'pub') item / &('const' / 'unsafe' / 'async') item / blocklike !('.' / '?') / expr ';' / macro &'}}'? )
-let <- 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';'
blocklike <- (NAME ':')? ('if' cond_expr block ('else' 'if' cond_expr block)* ('else' block)? / 'match' expr_ns '{{' inner* (arm)* '}}' / 'loop' block / 'while' cond_expr block / 'for' pattern 'in' expr_ns block / 'unsafe' block / block) / macro_block
-macro_block <- path '!' '{{' tokens* '}}'
-cond_expr <- expr_ns
-arm <- attr* '|'? pattern ('if' expr)? '=>' (blocklike ','? / expr (',' / &'}}'))
pattern <- '|'? pat1 ('|' pat1)*
pat1 <- ('ref' / 'mut')+ NAME ('@' pat1)? / '_' / ('&' / '&&') 'mut'? pat1 / '(' (pattern (',' pattern)* ','?)? ')' / '[' (pattern (',' pattern)* ','?)? ']' / '..' / macro
  / NAME '@' pat1 / patlit (('..=' / '..' / '...') patlit?)? / ('..=' / '..') patlit / NAME '@' pat1
-patlit <- '-'? NUM / STR / 'true' / 'false' / epath ('{{' (fieldpat (',' fieldpat)* ','?)? '}}' / '(' (pattern (',' pattern)* ','?)? ')')?
-fieldpat <- attr* ('..' / (NAME / NUM) ':' pattern / 'ref'? 'mut'? NAME)
expr <- jump / closure / range (({_ASSIGN} / '>' '>=') expr)?
-jump <- 'return' expr? / 'break' NAME? expr? / 'continue' NAME?
-closure <- 'static'? 'async'? 'move'? ('||' / '|' (attr* pat1 (':' type)? (',' attr* pat1 (':' type)?)* ','?)? '|') ('->' type_nb block / expr)
-range <- ('..=' / '..') bin? / bin (('..=' / '..') bin?)?
bin <- unary (('as' type_nb / binop unary / binop closure))*
-binop <- {_BRACE_BINARY}
unary <- ('!' / '-' / '*' / ('&' / '&&') ('mut' / NAME ('const' / 'mut'))? 'mut'?)* postfix
postfix <- primary tail*
-tail <- '?' / '.' ('await' / NUM / NAME ('::' targs)?) / '(' (expr (',' expr)* ','?)? ')' / '[' expr ']'
primary <- blocklike / NUM / STR / 'true' / 'false' / '(' attr* (expr (',' expr)* ','?)? ')' / '[' (expr (';' expr / (',' expr)* ','?))? ']' / ('async' / 'const') 'move'? block / macro / jump / structlit / closure / epath
-structlit <- epath '{{' (litfield (',' litfield)* ','?)? '}}'
-litfield <- attr* ('..' expr? / (NAME / NUM) (':' expr)?)
expr_ns <- 'let' pattern '=' bin_ns / jump / closure / range_ns (({_ASSIGN}) expr_ns)?
-range_ns <- ('..=' / '..') bin_ns? / bin_ns (('..=' / '..') (!'{{' bin_ns)?)?
bin_ns <- unary_ns ('as' type_nb / '&&' 'let' pattern '=' bin_ns / binop unary_ns)*
unary_ns <- ('!' / '-' / '*' / ('&' / '&&') 'mut'?)* postfix_ns
postfix_ns <- primary_ns tail*
primary_ns <- &('if' / 'match' / 'loop' / 'while' / 'for' / 'unsafe' / '{{') blocklike / NUM / STR / 'true' / 'false' / '(' (expr (',' expr)* ','?)? ')' / '[' (expr (';' expr / (',' expr)* ','?))? ']' / macro / closure / epath
"""
RUST = RUST.replace("ANYWORD", " / ".join(f"'{w}'" for w in "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()))
RUST = RUST.replace(" / '_' / (", " / (").replace("macro (';' / &NAME / !';' )", "macro ';'?").replace("macro &'}}'?", "macro")

RUBY = r"""
file <- stmts EOF
stmts <- sep* (stmt (sep+ stmt)* sep*)?
-sep <- NL / ';'
stmt <- stmt1 (modifier)*
-modifier <- 'if' not_expr / 'unless' not_expr / 'while' not_expr / 'until' not_expr / 'rescue' stmt1
-stmt1 <- 'alias' (NAME / STR) (NAME / STR) / 'undef' NAME / ('BEGIN' / 'END') '{' stmts '}' / not_expr
not_expr <- notted (NL? ('and' / 'or') NL* notted)*
-notted <- 'not' notted / expr
expr <- command / assignment / ternary
-assignment <- lefts '=' NL* (command / rights) / left ('=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '||=' / '&&=' / '|=' / '&=' / '^=' / '<<=' / '>>=') NL* (command / expr ('rescue' expr)?)
-lefts <- mleft (',' mleft)+
-mleft <- '*'? left / '(' lefts ')'
-rights <- '*'? ternary (',' '*'? ternary)*
left <- !((NUM / STR / 'nil' / 'true' / 'false' / 'self') '=') primary
-command <- ('return' / 'break' / 'next') (!('if' / 'unless' / 'while' / 'until' / 'and' / 'or') rights)? / ('yield' / 'super') !('(' / '[') callargs / 'redo' / 'retry'
  / primary_cmd !%nl &(NAME / NUM / STR / FSTART / 'nil' / 'true' / 'false' / 'self' / '->' / '::' / 'not' / 'lambda' / 'proc' / 'defined?' / 'def' / 'case' / '@' / '[' / '*' / '&' / ':' / '-' / '!' / '{' / '__' / 'super') !(binop_amb) callargs doblock?
-binop_amb <- '[' / '{' / '*' / '&' / '-' / ':' / '::' / '!' !'='
primary_cmd <- atom_cmd (('.' / '&.' / '::') name ('(' NL* args? NL* ')' braceblock?)? / '[' NL* args? NL* ']')*
-atom_cmd <- NAME ('(' NL* args? NL* ')')? / 'self' / STR / dstr / '(' stmts ')'
-name <- NAME / 'class' / 'end' / 'then' / 'in' / 'begin'
callargs <- arg (',' NL* arg)*
args <- arg (',' NL* arg)* ','?
-arg <- '...' / '*' ternary / '**' ternary / '&' ternary? / NAME ':' NL* (!(',' / ')' / NL) not_expr)? / STR ':' NL* not_expr / not_expr ('=>' NL* not_expr)? / 'if' ':' not_expr / 'class' ':' not_expr
ternary <- range ('?' NL* expr NL* ':' NL* expr)?
-range <- binary (('..' / '...') binary?)? / ('..' / '...') binary
binary <- unary (binop NL* unary)*
-binop <- '||' / '&&' / '<=>' / '==' / '===' / '=~' / '!~' / '!=' / '<=' / '>=' / '<<' / '>>' / '<' / '>' / '+' / '-' / '*' / '/' / '%' / '**' / '|' / '^' / '&'
unary <- ('!' / '-' / '+' / '~' / '&' / 'defined?')* primary
primary <- atom postop*
-postop <- ('.' / '&.') NL* (name / '(' args? ')') callparens? block? / '::' name callparens? block? / !%nl '[' NL* args? NL* ']' / '(' NL* args? NL* ')' block?
-callparens <- '(' NL* args? NL* ')'
block <- braceblock / doblock
-braceblock <- '{' blockparams? stmts '}'
-doblock <- 'do' blockparams? body 'end'
-blockparams <- NL* '|' params? (';' NAME (',' NAME)*)? '|'
params <- param (',' NL* param)* ','?
-param <- '*' NAME? / '**' (NAME / 'nil')? / '&' NAME? / '...' / NAME ':' (!(',' / ')' / '|' / NL) ternary)? / NAME '=' ternary_np / NAME / '(' params ')'
-ternary_np <- unary (('+' / '-' / '*' / '/' / '<<' / '**') unary)*
body <- stmts (rescue)* ('else' stmts)? ('ensure' stmts)?
-rescue <- 'rescue' (!('then' / NL / '=>') rights)? ('=>' left)? ('then' / sep) stmts
-then <- 'then' / sep+ 'then'? 
-dstr <- 'FSTART' ('F{' stmts 'F}')* 'FEND'
-atom <- NUM / (STR / dstr)+ / 'nil' / 'true' / 'false' / 'self' / 'redo' / 'retry' / '(' stmts ')' / '[' NL* args? NL* ']' / '{' NL* (pair (',' NL* pair)* ','?)? NL* '}'
  / 'def' (NL* (('self' / NAME) '.')? defname ('(' NL* params? NL* ')' / params)? ('=' NL* stmt / body 'end'))
  / 'class' ('<<' expr / cpath ('<' expr)?) sep body 'end' / 'module' cpath body 'end' / 'begin' body 'end'
  / ('if' / 'unless') not_expr then stmts ('elsif' not_expr then stmts)* ('else' stmts)? 'end'
  / ('while' / 'until') not_expr (DOLOOP / sep) stmts 'end' / 'for' lefts_for 'in' expr (DOLOOP / sep) stmts 'end'
  / 'case' expr? sep* ('when' rights_when then stmts)+ ('else' stmts)? 'end' / 'case' expr sep* ('in' rtop (('if' / 'unless') not_expr)? then stmts)+ ('else' stmts)? 'end'
  / '->' ('(' params? ')' / params)? block / 'yield' callparens? / 'super' callparens? block? / '::' NAME / 'return' / 'next' / 'break' / NAME block?
-cpath <- '::'? NAME ('::' NAME)*
-rights_when <- '*'? ternary (',' NL* '*'? ternary)*
-rtop <- rpair (',' NL* rpair)* ','? / ritem (',' NL* ritem)* ','?
-ritem <- '*' NAME? / rpat
rpat <- ralt ('=>' NAME)?
-ralt <- rone ('|' rone)*
-rone <- '^' (NAME / '(' expr ')') / '[' NL* (ritem (',' NL* ritem)* ','?)? NL* ']' / '{' NL* (rpair (',' NL* rpair)* ','?)? NL* '}' / '(' rpat ')' / cpath ('(' NL* rtop? NL* ')' / '[' NL* rtop? NL* ']') / range
-rpair <- '**' (NAME / 'nil') / (NAME / STR / 'if' / 'class' / 'end' / 'in' / 'do' / 'for') ':' (!(',' / '}' / ')' / NL / 'then' / 'if' / 'unless') rpat)?
-lefts_for <- NAME (',' NAME)*
-defname <- NAME / '[' ']' '='? / '<=>' / '==' / '===' / '=~' / '<=' / '>=' / '<<' / '>>' / '<' / '>' / '+' / '-' / '*' / '/' / '%' / '**' / '!' / '~' / '|' / '^' / '&' / name
-pair <- '**' ternary / (NAME / STR / 'if' / 'class' / 'end' / 'in' / 'do' / 'for') ':' NL* (!(',' / '}' / NL) not_expr)? / expr '=>' NL* expr
"""

SQL = r"""
file <- ';'* (stmt (';'+ / EOFNEXT))* EOF
stmt <- merge / 'CMD' part* / select_stmt / insert / update / delete / create / alter / drop / 'truncate' 'table'? name (',' name)* / transaction / grant / NAMED
-transaction <- 'begin' NAME? / 'commit' NAME? / 'rollback' NAME? (NAME? 'to' NAME NAME?)?
-grant <- 'grant' words 'on' ('table' name / NAME name !'(' &'to' / name) 'to' name (',' name)* / 'revoke' words ('on' NAME? name) 'from' name (',' name)*
-part <- '(' part* ')' / body / !(';' / ')' / EOF / BAD) anytoken
body <- 'begin' (body / 'end' ('if' / 'case') / ';' / '(' part* ')' / !('end' / 'begin' / EOF / BAD / ')') anytoken / 'case' (!('end' / EOF) (part / ';'))* 'end')* 'end'
-anytoken <- ANYSQL
merge <- 'merge' 'into'? name alias_u? 'using' primary_src 'on' expr ('when' 'not'? NAME ('by' NAME)? ('and' expr)? 'then' ('update' 'set' setitems / 'insert' ('(' names ')')? ('values' tuple / 'default' 'values') / 'delete' / NAME NAME))+ returning?
-words <- word (',' word)*
-word <- 'select' / 'insert' / 'update' / 'delete' / 'all' NAME? / NAME
with <- 'with' 'recursive'? cte (',' cte)*
-cte <- name ('(' names ')')? 'as' ('not'? 'materialized')? '(' stmt ')'
select_stmt <- with? select_core (('union' / 'intersect' / 'except') ('all' / 'distinct')? select_core)* order? limit* lock* / with (insert / update / delete)
-order <- 'order' 'by' orderitem (',' orderitem)*
-orderitem <- expr ('asc' / 'desc')? (NAME NAME)?
-lock <- 'for' ('update' / 'key' / NAME)+ (NAME? name (',' name)*)?
-limit <- 'limit' expr (',' expr)? / 'offset' expr ('row' / 'rows' / NAME)? / 'fetch' NAME expr? ('row' / 'rows') (NAME / 'with')+
select_core <- 'select' ('all' / 'distinct' ('on' '(' exprs ')')?)? (NAME NUM NAME?)? selitem (',' selitem)* ('from' source (',' source)*)? ('where' expr)? ('group' 'by' ('all' / gitem (',' gitem)*))? ('having' expr)? ('window' NAME 'as' '(' window ')' (',' NAME 'as' '(' window ')')*)?
  / 'values' tuple (',' tuple)* / '(' select_stmt ')' / 'table' name
-gitem <- '(' ')' / NAME NAME '(' gitem (',' gitem)* ')' / expr
-selitem <- '*' / name '.' '*' / expr ('as' (ident / STR) / ident)?
-source <- primary_src (joinkind primary_src ('on' expr / 'using' '(' names ')')?)*
-joinkind <- 'natural'? ('inner' / ('left' / 'right' / 'full') 'outer'? / 'cross')? 'join'
primary_src <- NAME? '(' select_stmt ')' alias? / '(' source ')' alias? / name ('(' exprs? ')')? sample? alias?
-sample <- NAME NAME '(' expr NAME? ')' (NAME '(' expr ')')?
-alias <- 'as'? NAME ('(' names ')')?
-ident <- NAME / 'row' / 'range' / 'rows' / 'replace' / 'key' / 'temp' / 'temporary' / 'current' / 'over' / 'partition' / 'to' / 'if' / 'begin' / 'grant' / 'left' / 'right' / 'truncate' / 'add' / 'check'
name <- NAME (('.' / ':') (NAME / ident_dot))*
-ident_dot <- 'row' / 'key' / 'range' / 'values' / 'order' / 'group' / 'table' / 'index'
-names <- NAME (',' NAME)*
tuple <- '(' (valexpr (',' valexpr)*)? ')'
-valexpr <- 'default' / expr
insert <- ('insert' ('or' (NAME / 'replace' / 'rollback'))? 'into' / 'replace' 'into'?) name ('as' NAME)? ('(' names ')')? ('values' tuple (',' tuple)* / select_stmt / 'default' 'values') upsert? returning?
-upsert <- 'on' NAME ('(' exprs ')')? ('where' expr)? NAME (NAME / 'update' 'set' setitems ('where' expr)?)
-setitems <- setitem (',' setitem)*
-setitem <- (name / '(' names ')') '=' valexpr
-returning <- 'returning' selitem (',' selitem)*
update <- 'update' name alias_u? 'set' setitems ('from' source (',' source)*)? ('where' expr)? returning?
-alias_u <- 'as'? NAME
delete <- 'delete' 'from' name alias_u? ('using' source (',' source)*)? ('where' expr)? returning?
create <- 'create' ('or' 'replace')? (OBJ part+ / ('temp' / 'temporary' / NAME)? 'table' notexists? name ('(' element (',' element)* ','? ')' options / 'as' '('? select_stmt ')'?) options ('as' select_stmt)?
  / ('temp' / 'temporary' / 'recursive' / 'materialized')* 'view' notexists? name ('(' names ')')? options 'as' select_stmt ('with' NAME? 'check'? NAME?)?
  / 'unique'? 'index' NAME? notexists? name? 'on' name ('using' NAME)? '(' orderitem (',' orderitem)* ')' options ('where' expr)?
  / NAME notexists? name (NAME / NUM / '=' / 'with' / STR / 'by' / 'default')*)
-notexists <- 'if' 'not' 'exists'
-options <- (NAME '='? (NAME / NUM / STR) / 'default'? NAME 'set'? '='? NAME / 'with' '(' (NAME '=' (NAME / NUM / STR) ','?)* ')' / 'partition' 'by' ('range' / NAME)? '(' exprs ')' / NAME 'by' '(' exprs ')' / 'without' NAME / NAME)*
element <- constraint / column
column <- (NAME / STR / ident) type? colopt*
type <- NAME (NAME !'(' / 'with' NAME NAME 'row'?)* ('(' (NUM / NAME / STR) (',' (NUM / STR / NAME))* ')')? (NAME / 'with' NAME NAME)* ('[' NUM? ']')* / NAME '<' type (',' type)* '>'
-colopt <- 'not' 'null' / 'null' / 'primary' 'key' ('asc' / 'desc')? NAME? / 'unique' 'key'? / 'default' defval / 'check' '(' expr ')' / 'references' name ('(' names ')')? refopt* / 'constraint' NAME / 'on' 'update' expr / NAME 'as'? ('(' expr ')')? / 'as' '(' expr ')' NAME? / NAME STR?
-defval <- '(' expr ')' / ('-' / '+')? (NUM / STR) ('::' type)? / 'null' / 'true' / 'false' / 'current' / NAME ('(' exprs? ')')? ('::' type)?
-refopt <- 'on' ('delete' / 'update') ('set' ('null' / 'default') / NAME NAME?) / NAME
constraint <- ('constraint' NAME)? ('primary' 'key' NAME? '(' names_o ')' / 'unique' ('key' / 'index')? NAME? '(' names_o ')' / 'foreign' 'key' NAME? '(' names ')' 'references' name ('(' names ')')? refopt* / 'check' '(' expr ')' / ('index' / 'key') NAME? '(' names_o ')')
-names_o <- NAME ('asc' / 'desc')? (',' NAME ('asc' / 'desc')?)*
alter <- 'alter' ('table' ('if' 'exists')? name / NAME name / 'view' name / 'column' name) altop (',' altop)*
-altop <- 'add' (constraint / 'column'? notexists? (element / '(' element (',' element)* ')')) / 'drop' ('column' / 'constraint')? ('if' 'exists')? NAME NAME? / NAME ('column' / 'constraint')? NAME? 'to' NAME / NAME 'to' NAME / 'alter' 'column'? NAME (NAME? type / 'set' ('default' expr / 'not' 'null' / NAME type) / 'drop' ('default' / 'not' 'null')) / NAME 'column'? NAME type colopt* / 'set' NAME NAME? / NAME 'to' NAME
drop <- 'drop' ('table' / 'view' / 'index' / 'materialized' 'view' / 'column' / NAME) ('if' 'exists')? name (',' name)* NAME?
exprs <- expr (',' expr)*
expr <- and_e ('or' and_e)*
-and_e <- not_e ('and' not_e)*
not_e <- 'not' not_e / compare
compare <- add (('=' / '<>' / '!=' / '<=' / '>=' / '<' / '>' / '~' '*'? / '!' '~' '*'?) (('all' / NAME) &'(')? add / 'is' 'not'? ('null' / 'true' / 'false' / NAME / 'distinct' 'from' add) / 'not'? ('in' '(' (select_stmt / exprs) ')' / ('like' / 'ilike') add (NAME STR)? / 'between' add 'and' add))*
add <- mul (('+' / '-' / '||' / '*' / '/' / '%' / '->' / '->>' / '&' / '|' / '^') mul)*
-mul <- ('-' / '+')* cast
cast <- primary ('::' type / '[' (expr (',' expr)*)? (':' expr?)? ']' / '.' NAME)*
primary <- NUM / 'exists' '(' select_stmt ')' / 'case' expr? ('when' expr 'then' expr)+ ('else' expr)? 'end' / 'cast' '(' expr 'as' type ')' / '(' (select_stmt / exprs) ')' / 'null' / 'true' / 'false' / '?' / '*'
  / NAME STR NAME? / STR+ / (name / 'replace' / 'left' / 'right' / 'if' / 'insert' / 'values' / 'window') '(' ('distinct' / 'all')? (callarg (',' callarg)*)? order? ')' (NAME '(' ('where' expr / order) ')')? ('over' (NAME / '(' window ')'))? / name / ident
-callarg <- expr (('from' / 'as' / 'in' / 'using') (type / expr))? ('from' expr)? ('for' expr)? (NAME STR)?
window <- NAME? ('partition' 'by' exprs)? order? (('rows' / 'range') frame)?
-frame <- 'between' bound 'and' bound / bound
-bound <- 'unbounded' ('preceding' / 'following') / 'current' 'row' / expr ('preceding' / 'following')
"""
SQL = SQL.replace("ANYSQL", " / ".join([*_CLASSES, *(f"'{w}'" for w in [*KEYWORDS["sql"].split(), "for", "fetch", "window", "merge", *_SIGNS])]))
SQL = SQL.replace("EOFNEXT", "&EOF").replace(" / NAMED", "").replace("'without' NAME / ", "")

TEXTS = {
    "python": PYTHON, "javascript": _script(_PLAIN), "typescript": _script(_TYPED, _TYPES), "java": JAVA, "csharp": CSHARP,
    "c": C, "go": GO, "rust": RUST, "ruby": RUBY, "sql": SQL,
}


@cache
def grammar(language: str) -> Grammar:
    return Grammar(TEXTS[language])
