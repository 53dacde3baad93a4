"""Grammars of the languages in the notation of ``engine.network``; the dialects of a language run together.

They take what the languages' own parsers take before names and types are looked at. Expressions are given flat, without precedence:
it decides what a text means, not whether it is one.
"""

from __future__ import annotations

from functools import lru_cache

from arbora.llm.syntax.engine import Network, network

PYTHON = r"""
file: (NEWLINE | stmt)* END
field: exprlist NEWLINE END | yield NEWLINE END | lambda NEWLINE END | name ':=' expr NEWLINE END
name: NAME | 'match' | 'case' | 'type'
stmt: line | if | while | for | try | with | def | class | 'async' (for | with | def) | decorated | @py310 match
line: simple (';' simple)* ';'? NEWLINE
simple: exprlist | assign | 'pass' | 'break' | 'continue' | 'return' exprlist? | 'raise' (expr ('from' expr)?)? | 'del' targets | 'assert' expr (',' expr)?
  | 'global' name (',' name)* | 'nonlocal' name (',' name)* | 'import' dotted ('as' name)? (',' dotted ('as' name)?)* | from | yield | @py312 'type' name tparams? '=' expr
from: 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | imported (',' imported)* | '(' imported (',' imported)* ','? ')')
imported: name ('as' name)?
dotted: name ('.' name)*
assign: (targets '=')+ (exprlist | yield) | single ':' expr ('=' (exprlist | yield))? | single augmented (exprlist | yield)
augmented: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
single: name | '(' single ')' | reached
targets: target (',' target)* ','?
target: '*' bare | bare
bare: name | '(' targets? ')' | '[' targets? ']' | reached
reached: atom trailer* ('.' name | '[' slices ']')
yield: 'yield' ('from' expr | exprlist)?
exprlist: starred (',' starred)* ','?
starred: '*' arith | expr
expr: either ('if' either 'else' expr)? | lambda
named: name ':=' expr | expr
either: negated (('or' | 'and') negated)*
negated: 'not'* arith (compare arith)*
compare: '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' 'not'?
arith: operand (binary operand)*
binary: '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '&' | '|' | '^' | '<<' | '>>'
operand: ('+' | '-' | '~')* 'await'? atom trailer*
trailer: '.' name | '(' args? ')' | '[' slices ']'
atom: name | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' (yield | inner)? ')' | '[' inner? ']' | '{' (pairs | inner)? '}'
inner: (named | '*' arith) (',' (named | '*' arith))* ','? | named comp
pairs: pair (',' pair)* ','? | expr ':' expr comp
pair: expr ':' expr | '**' arith
comp: ('async'? 'for' targets 'in' either ('if' condition)*)+
condition: either | lambda | name ':=' either
args: arg (',' arg)* ','?
arg: named comp? | name '=' expr | '*' expr | '**' expr
slices: slice (',' slice)* ','?
slice: named | @py311 '*' arith | expr? ':' expr? (':' expr?)?
lambda: 'lambda' lparams? ':' expr
lparams: lparam (',' lparam)* ','?
lparam: name ('=' expr)? | '*' name? | '**' name | '/'
params: param (',' param)* ','?
param: name (':' expr)? ('=' expr)? | '*' (name (':' ('*' arith | expr))?)? | '**' name (':' expr)? | '/'
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: ('*' | '**')? name (':' expr)? ('=' starred)?
suite: line | NEWLINE INDENT stmt+ DEDENT
if: 'if' named ':' suite ('elif' named ':' suite)* else?
else: 'else' ':' suite
while: 'while' named ':' suite else?
for: 'for' targets 'in' exprlist ':' suite else?
try: 'try' ':' suite (handler+ else? finally? | finally)
handler: 'except' ((expr | @py314 expr (',' expr)+) ('as' name)?)? ':' suite | @py311 'except' '*' expr ('as' name)? ':' suite
finally: 'finally' ':' suite
with: 'with' (item (',' item)* | @py310 '(' item (',' item)* ','? ')') ':' suite
item: expr ('as' target)?
decorated: ('@' named NEWLINE)+ (def | class | 'async' def)
def: 'def' name (@py312 tparams)? '(' params? ')' ('->' exprlist)? ':' suite
class: 'class' name (@py312 tparams)? ('(' args? ')')? ':' suite
match: 'match' (exprlist | named) ':' NEWLINE INDENT case+ DEDENT
case: 'case' patterns ('if' named)? ':' suite
patterns: pattern (',' pattern)* ','?
pattern: '*' name | closed ('|' closed)* ('as' name)?
closed: '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' (argpattern (',' argpattern)* ','?)? ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' (mapped (',' mapped)* ','?)? '}'
argpattern: (name '=')? pattern
mapped: ('-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted) ':' pattern | '**' name
"""

JAVASCRIPT = r"""
file: STR? item* END
item: stmt | @module import | @module export
name: NAME | 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | @=script 'let' | @=script 'static' | @=script 'yield' | @=script 'await'
word: NAME | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'export' | 'extends' | 'finally' | 'for' | 'function'
  | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' | 'null' | 'true' | 'false'
  | 'let' | 'static' | 'yield' | 'await' | 'async' | 'of' | 'get' | 'set' | 'enum' | 'from' | 'as'
import: 'import' (STR | clause 'from' STR) attributes? SEMI
attributes: 'with' '{' (word | STR ':' STR ','?)* '}'
clause: name (',' (star | names))? | star | names
star: '*' 'as' name
names: '{' (nameas (',' nameas)* ','?)? '}'
nameas: (word | STR) ('as' (word | STR))?
export: 'export' ('default' (function | class | 'async' function | assign~default SEMI) | '*' ('as' (word | STR))? 'from' STR attributes? SEMI | names ('from' STR attributes?)? SEMI | declare | vars SEMI)
declare: function | class | 'async' function
block: '{' stmt* '}'
stmt: block | ';' | vars SEMI | declare | expr~statement SEMI | 'if' '(' expr ')' stmt ('else' stmt)? | 'for' (@module 'await')? '(' forhead ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' (SEMI | ';')?
  | 'for' 'await' '(' forhead ')' stmt | 'continue' name? SEMI | 'break' name? SEMI | 'return' expr? SEMI | @=script 'with' '(' expr ')' stmt | 'switch' '(' expr ')' '{' case* '}' | name ':' stmt
  | 'throw' expr SEMI | 'try' block ('catch' ('(' binding ')')? block)? ('finally' block)? | 'debugger' SEMI
case: ('case' expr | 'default') ':' stmt*
vars: ('var' | 'let' | 'const') declarator (',' declarator)*
declarator: name ('=' assign)? | pattern '=' assign
forhead: (vars | expr)? ';' expr? ';' expr? | ('var' | 'let' | 'const') binding ('of' assign | 'in' expr) | reference ('of' assign | 'in' expr) | pattern ('of' assign | 'in' expr)
binding: name | pattern
pattern: '[' (','* element (','+ element)* ','*)? ']' | '[' ','+ ']' | '{' (property (',' property)* ','?)? '}'
element: '...' bound | bound ('=' assign)?
bound: binding | reference
property: '...' bound | name ('=' assign)? | key ':' bound ('=' assign)?
key: word | STR | NUM | '[' assign ']'
params: param (',' param)* (',' ('...' binding)?)? | '...' binding
param: binding ('=' assign)?
body: '{' stmt* '}'
function: 'function' '*'? (name | 'yield' | 'await')? '(' params? ')' body
class: 'class' name? ('extends' head)? '{' (member | ';')* '}'
member: decorator* 'static'? ('async'? '*'? | 'get' | 'set') memberkey '(' params? ')' body | decorator* 'static'? memberkey ('=' assign)? SEMI | 'static' block
decorator: '@' head
memberkey: key | '#' word
expr: assign (',' assign)*
assign: reference assignment assign | pattern '=' assign | arrow | cond | 'yield' ('*'? assign)?
assignment: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
arrow: 'async'? (name | '(' params? ')') '=>' (body | assign~body)
cond: binary ('?' assign ':' assign)?
binary: (unary | '#' word 'in' unary) (operator unary)*
operator: '||' | '&&' | '??' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'instanceof' | 'in' | '<<' | '>>' | '>>>' | '+' | '-' | '*' | '/' | '%' | '**'
unary: ('delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | 'await')* (head | ('++' | '--') reference | reference ('++' | '--'))
head: primary suffix*
reference: name | primary suffix* ('.' (word | '#' word) | '[' expr ']') | '(' reference ')'
suffix: '.' (word | '#' word) | '?.' (word | '#' word | args | '[' expr ']' | template) | '[' expr ']' | args | template
args: '(' (('...'? assign) (',' '...'? assign)* ','?)? ')'
template: TPL | TPL_HEAD expr (TPL_MID expr)* TPL_TAIL
primary: 'this' | 'super' | name | NUM | STR | REGEX | 'null' | 'true' | 'false' | template | '(' expr ')' | array | object | function | 'async' function | class | 'new' ('.' NAME | newhead args?) | 'import' ('.' NAME | args)
newhead: newprimary ('.' (word | '#' word) | '[' expr ']' | template)*
newprimary: 'this' | 'super' | name | NUM | STR | REGEX | 'null' | 'true' | 'false' | template | '(' expr ')' | array | object | function | class | 'new' ('.' NAME | newhead args?) | 'import' '.' NAME
array: '[' (','* '...'? assign (','+ '...'? assign)* ','*)? ']' | '[' ','+ ']'
object: '{' (pair (',' pair)* ','?)? '}'
pair: '...' assign | name | key ':' assign | ('async'? '*'? | 'get' | 'set') key '(' params? ')' body
"""

JAVA = r"""
file: package? import* (type | ';')* END | annotations? 'open'? 'module' qualified '{' directive* '}' END
package: annotations? 'package' qualified ';'
import: 'import' 'static'? qualified ('.' '*')? ';' | ';'
directive: name qualified (name qualified (',' qualified)*)? ';'
name: NAME | 'record' | 'sealed' | 'permits' | 'var' | 'yield' | 'when' | 'module'
qualified: name ('.' name)*
annotations: annotation+
annotation: '@' qualified ('(' (element (',' element)* | value)? ')')?
element: name '=' value
value: cond | annotation | '{' (value (',' value)*)? ','? '}'
modifiers: modifier+
modifier: annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | @java17 'sealed' | @java17 'non-sealed'
type: modifiers? (class | interface | enum | 'annotated' | @java17 record | atype)
class: 'class' name tparams? ('extends' ref)? ('implements' refs)? (@java17 'permits' refs)? classbody
interface: 'interface' name tparams? ('extends' refs)? (@java17 'permits' refs)? classbody
enum: 'enum' name ('implements' refs)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant: annotations? name args? classbody?
record: 'record' name tparams? '(' (component (',' component)*)? ')' ('implements' refs)? classbody
component: annotations? ref (annotations? '...')? name
atype: '@' 'interface' name '{' amember* '}'
amember: ';' | modifiers? (ref name '(' ')' dims? ('default' value)? ';' | ref vars ';' | class | interface | enum | atype)
classbody: '{' member* '}'
member: ';' | 'static'? block | modifiers? (class | interface | enum | atype | @java17 record | method | constructor | ref vars ';') | modifiers? @java17 name block
method: tparams? annotations? ('void' | ref) name '(' params? ')' dims? ('throws' refs)? (block | ';')
constructor: tparams? name '(' params? ')' ('throws' refs)? block
params: param (',' param)*
param: (annotation | 'final')* ref (annotations? '...')? (name ('.' 'this')? dims? | 'this')
tparams: '<' tparam (',' tparam)* '>'
tparam: annotations? name ('extends' ref ('&' ref)*)?
refs: ref (',' ref)*
primitive: 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double'
ref: annotations? (primitive | classref) (annotations? '[' ']')*
classref: name targs? ('.' annotations? name targs?)*
targs: '<' (targ (',' targ)*)? '>'
targ: ref | annotations? '?' (('extends' | 'super') ref)?
dims: (annotations? '[' ']')+
vars: variable (',' variable)*
variable: name dims? ('=' init)?
init: expr | '{' (init (',' init)*)? ','? '}'
block: '{' stmt* '}'
stmt: local ';' | (modifier)* (class | interface | enum | @java17 record) | statement
local: (annotation | 'final')* ref vars
statement: block | ';' | exprstmt ';' | 'if' '(' expr ')' statement ('else' statement)? | 'assert' expr (':' expr)? ';' | 'switch' '(' expr ')' switchbody | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';'
  | 'for' '(' (forinit? ';' expr? ';' (exprstmt (',' exprstmt)*)? | (annotation | 'final')* ref name dims? ':' expr) ')' statement | 'break' name? ';' | 'continue' name? ';' | 'return' expr? ';' | 'throw' expr ';'
  | 'synchronized' '(' expr ')' block | 'try' resources? block catch* ('finally' block)? | name ':' statement | @java17 'yield' expr ';'
resources: '(' resource (';' resource)* ';'? ')'
resource: (annotation | 'final')* ref name '=' expr | head
catch: 'catch' '(' (annotation | 'final')* ref ('|' ref)* name ')' block
forinit: local | exprstmt (',' exprstmt)*
switchbody: '{' (labels stmt*)* '}' | @java17 '{' (label '->' (exprstmt ';' | expr ';' | block | 'throw' expr ';'))* '}'
labels: label ':'
label: 'default' | 'case' caselabel (',' caselabel)*
caselabel: cond | @java21 'default' | @java21 casepattern ('when' expr)?
casepattern: (annotation | 'final')* ref (name | '(' (casepattern (',' casepattern)*)? ')' name?)
exprstmt: ('++' | '--') unary | head ('++' | '--') | head assignment expr | called
called: head (args | '.' targs? name args | '.' 'new' creator) | name args | 'new' creator | ('this' | 'super') args
assignment: '=' | '+=' | '-=' | '*=' | '/=' | '&=' | '|=' | '^=' | '%=' | '<<=' | '>' '>=' | '>' '>' '>='
expr: head assignment expr | lambda | cond
lambda: (name | '(' (name (',' name)* | params)? ')') '->' (expr | block)
cond: binary ('?' expr ':' (cond | lambda))?
binary: unary (operator unary | 'instanceof' (ref | @java17 casepattern))*
operator: '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%'
unary: ('++' | '--' | '+' | '-') unary | ('~' | '!') unary | cast | head ('++' | '--')* | @java17 'switch' '(' expr ')' switchbody
cast: '(' ref ('&' ref)* ')' (unary | lambda)
head: primary suffix*
suffix: '.' (targs? name | 'this' | 'class' | 'super' | 'new' creator) | args | '[' expr ']' | '::' targs? (name | 'new')
args: '(' (expr (',' expr)*)? ')'
primary: name | NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | 'new' creator | 'void' '.' 'class' | ref ('.' 'class' | '::' targs? (name | 'new'))
creator: annotations? targs? (classref args classbody? | (primitive | classref) (annotations? '[' expr ']')+ dims? | (primitive | classref) dims '{' (init (',' init)*)? ','? '}')
"""

C = r"""
file: external* END
external: specs attribute* initial? ';' | aggregate ';' | specs defined attribute* block | @=c99 specs old declaration+ block | ';' | assertion | asm
  | '__extension__' external
declaration: specs initial? ';' | aggregate ';' | assertion | '__extension__' declaration
initial: initialised (',' attribute* initialised)*
initialised: declarator asm1? attribute* ('=' init)? attribute*
specs: mod* kind mod*
mod: 'typedef' | 'extern' | 'static' | 'auto' | 'register' | 'inline' | '__inline' | '__inline__' | '_Noreturn' | '_Thread_local' | 'thread_local' | qualifier | attribute | '_Alignas' '(' (typename | cond) ')' | 'alignas' '(' (typename | cond) ')' | @c23 'constexpr'
qualifier: 'const' | '__const' | 'volatile' | '__volatile__' | 'restrict' | '__restrict' | '__restrict__' | '_Atomic'
attribute: '__attribute__' '(' '(' balanced* ')' ')' | @c23 '[' '[' balanced* ']' ']'
balanced: NAME | NUM | STR | ',' | '=' | 'const' | ':' | '.' | '*' | '-' | '+' | word | '(' balanced* ')' | '[' balanced* ']'
word: 'int' | 'char' | 'long' | 'unsigned' | 'signed' | 'void' | 'inline' | 'static'
kind: builtin (mod* builtin)* | NAME | aggregate | '_Atomic' '(' typename ')' | ('typeof' | '__typeof__' | 'typeof_unqual') '(' (expr | typename) ')'
builtin: 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | 'bool' | '_Complex' | '_Imaginary'
aggregate: ('struct' | 'union') attribute* (NAME? '{' field* '}' attribute* | NAME) | 'enum' attribute* (NAME? (@c23 ':' specs)? '{' enumerator (',' enumerator)* ','? '}' attribute* | NAME)
field: specs (fielddecl (',' fielddecl)*)? ';' | aggregate ';' | ';' | assertion | '__extension__' field
fielddecl: declarator (':' cond)? attribute* | ':' cond
enumerator: NAME attribute* ('=' cond)?
declarator: ('*' (qualifier | attribute)*)* direct
direct: (NAME | '(' attribute* declarator ')') dsuffix*
dsuffix: '[' ('static' | qualifier)* ('*' | assign)? ']' | '(' (params | NAME (',' NAME)*)? ')'
defined: ('*' (qualifier | attribute)*)* (NAME | '(' attribute* declarator ')') dsuffix* '(' (named (',' named)* (',' '...')? | 'void')? ')' | ('*' (qualifier | attribute)*)* '(' defined ')' dsuffix*
named: specs attribute* declarator attribute*
old: ('*' (qualifier | attribute)*)* NAME '(' NAME (',' NAME)* ')'
params: param (',' param)* (',' '...')? | @c23 '...'
param: specs attribute* (declarator | abstract)? attribute*
abstract: ('*' (qualifier | attribute)*)+ adirect? | adirect
adirect: ('(' abstract ')' | '[' ('static' | qualifier)* ('*' | assign)? ']' | '(' params? ')') ('[' ('static' | qualifier)* ('*' | assign)? ']' | '(' params? ')')*
typename: (mod | qualifier)* kind mod* abstract?
init: assign | braces
braces: '{' (designated (',' designated)* ','?)? '}'
designated: (designator+ '=' | NAME ':')? init
designator: '.' NAME | '[' cond ('...' cond)? ']'
assertion: ('_Static_assert' | 'static_assert') '(' cond (',' STR+)? ')' ';'
asm: asm1 ';'
asm1: ('asm' | '__asm__' | '__asm') ('volatile' | '__volatile__' | 'goto' | 'inline')* '(' STR+ (':' operands?)* ')'
operands: operand (',' operand)*
operand: ('[' NAME ']')? STR+ ('(' expr ')')? | NAME
block: '{' entry* '}'
entry: declaration | stmt
stmt: block | expr? ';' | NAME ':' attribute* (stmt | declaration)? | 'case' cond ('...' cond)? ':' (stmt | declaration)? | 'default' ':' (stmt | declaration)? | 'if' '(' expr ')' stmt ('else' stmt)? | 'switch' '(' expr ')' stmt
  | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (declaration | expr? ';') expr? ';' expr? ')' stmt | 'goto' '*'? expr ';' | 'continue' ';' | 'break' ';' | 'return' (expr | braces)? ';' | asm | attribute ';'
expr: assign (',' assign)*
assign: unary assignment assign | cond
assignment: '=' | '*=' | '/=' | '%=' | '+=' | '-=' | '<<=' | '>>=' | '&=' | '^=' | '|='
cond: binary ('?' expr? ':' cond)?
binary: cast (operator cast)*
operator: '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%'
cast: unary | '(' typename ')' cast
unary: postfix | ('++' | '--') unary | ('&' | '*' | '+' | '-' | '~' | '!' | '&&' | '__extension__') cast | ('sizeof' | '_Alignof' | 'alignof') (unary | '(' typename ')')
postfix: primary ('[' expr ']' | '(' (argument (',' argument)*)? ')' | ('.' | '->') NAME | '++' | '--')*
argument: assign | typename
primary: NAME | NUM | (STR | NAME)* STR (STR | NAME)* | 'true' | 'false' | 'nullptr' | '(' expr ')' | '(' block ')' | '(' typename ')' braces | '_Generic' '(' assign (',' (typename | 'default') ':' assign)+ ')'
"""

#: Per language its grammar, its dialects in order, and the rules whose results are kept.
LANGUAGES = {
    "python": (PYTHON, ("py38", "py310", "py311", "py312", "py314"), ("stmt", "expr")),
    "javascript": (JAVASCRIPT, ("script", "module"), ("stmt", "assign")),
    "java": (JAVA, ("java8", "java17", "java21"), ("member", "stmt", "expr", "ref")),
    "c": (C, ("c99", "c11", "c23"), ("external", "entry", "assign", "specs")),
}
#: Tokens that a JavaScript expression may not begin with as a statement, as an arrow function's body, and as a default export.
WITHOUT = {"statement": frozenset(("{", "function", "class")), "body": frozenset("{"), "default": frozenset(("function", "class"))}
EXTENSIONS = {"py": "python", "js": "javascript", "java": "java", "c": "c"}


@lru_cache(maxsize=None)
def grammar(language: str) -> Network:
    return network(*LANGUAGES[language], WITHOUT)
