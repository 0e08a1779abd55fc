"""Grammars of nine languages for the derivative parser.

They cover the syntax of the languages over the tokens of ``lexing``; precedence does not matter for
validity, so expressions are operands joined by operators. Where a language's grammar leans on
knowledge of names (types in C and C++), both readings are admitted.
"""

from __future__ import annotations

import re
from functools import lru_cache

from lodeseek.llm.derivatives import Grammar

PYTHON = r"""
file = (NL | stmt)* ;
stmt = simple | compound ;
simple = small (';' small)* ';'? NL ;
small = exprs_stmt | 'del' deltargets | 'pass' | 'break' | 'continue' | 'return' tuple? | 'raise' (expr ('from' expr)?)?
  | 'global' names | 'nonlocal' names | 'assert' expr (',' expr)? | imports | 'type' ID typeparams? '=' expr ;
names = ID (',' ID)* ;
imports = 'import' asname (',' asname)* | 'from' ('.' | '...')* dotted? 'import' ('*' | fromnames | '(' fromnames ','? ')') ;
fromnames = ID ('as' ID)? (',' ID ('as' ID)?)* ;
asname = dotted ('as' ID)? ;
dotted = ID ('.' ID)* ;
exprs_stmt = plainexprs | single ':' expr ('=' plainexprs)? | single AUG plainexprs | (targets '=')+ plainexprs ;
-- what is assigned to: a name, or what ends in an attribute or a subscript
place = ID | atom (call* access)+ ;
call = '(' args? ')' ;
access = '.' ID | '[' subs ']' ;
single = place | '(' single ')' ;
target = '*'? (place | '(' targets? ')' | '[' targets? ']') ;
targets = target (',' target)* ','? ;
deltarget = place | '(' deltargets? ')' | '[' deltargets? ']' ;
deltargets = deltarget (',' deltarget)* ','? ;
-- statements know no bare named expression
plainexprs = yields | tuple ;
yields = 'yield' ('from' ternary | tuple)? ;
tuple = plainexpr (',' plainexpr)* ','? ;
plainexpr = '*' comparison | ternary ;
ternary = 'lambda' lambdaparams? ':' expr | binary ('if' binary 'else' ternary)? ;
starexprs = starexpr (',' starexpr)* ','? ;
starexpr = '*' comparison | expr ;
expr = 'lambda' lambdaparams? ':' expr | binary ('if' binary 'else' expr)? (':=' expr)? ;
lambdaparams = (lambdaplain (',' lambdastar)? | lambdastar) ','? ;
lambdaplain = ID (',' ID)* (',' '/' (',' ID)*)? (',' lambdaset)* | (ID ',')* lambdaset (',' lambdaset)* (',' '/' (',' lambdaset)*)? ;
lambdaset = ID '=' expr ;
lambdastar = '*' (ID (',' ID ('=' expr)?)* | (',' ID ('=' expr)?)+) (',' '**' ID)? | '**' ID ;
binary = negation (('and' | 'or') negation)* ;
negation = 'not'* comparison ;
comparison = unary (BIN unary)* ;
unary = ('-' | '+' | '~')* 'await'? postfix ;
postfix = atom (call | access)* ;
atom = ID | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' (comp | starexprs | yields)? ')' | '[' (comp | starexprs)? ']' | '{' dictset? '}' ;
comp = starexpr compfor ;
compfor = ('async'? 'for' targets 'in' binary ('if' binary)*)+ ;
args = arglist ','? | expr compfor ;
arglist = posarg (',' posarg)* (',' kwargs)? | kwargs ;
posarg = '*'? expr ;
kwargs = kwarg (',' (kwarg | '*' expr))* (',' (kwarg | '**' expr))* | '**' expr (',' (kwarg | '**' expr))* ;
kwarg = ID '=' expr ;
subs = sub (',' sub)* ','? ;
sub = starexpr | expr? ':' expr? (':' expr?)? ;
dictset = expr (':' expr (compfor | (',' ditem)* ','?) | compfor | (',' sitem)* ','?) | '**' expr (',' ditem)* ','? | '*' expr (',' sitem)* ','? ;
ditem = '**' expr | expr ':' expr ;
sitem = '*'? expr ;
compound = ifs | whiles | fors | trys | withs | def | class | 'async' (fors | withs | def) | decorated | match ;
block = simple | NL INDENT (stmt | NL)+ DEDENT ;
ifs = 'if' expr ':' block ('elif' expr ':' block)* ('else' ':' block)? ;
whiles = 'while' expr ':' block ('else' ':' block)? ;
fors = 'for' targets 'in' tuple ':' block ('else' ':' block)? ;
trys = 'try' ':' block (('except' '*'? (expr (',' expr)* ('as' ID)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block) ;
withs = 'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' block ;
withitem = expr ('as' target)? ;
def = 'def' ID typeparams? '(' params? ')' ('->' expr)? ':' block ;
typeparams = '[' typeparam (',' typeparam)* ','? ']' ;
typeparam = ('*' | '**')? ID (':' expr)? ('=' expr)? ;
params = (plain (',' star)? | star) ','? ;
plain = param (',' param)* (',' '/' (',' param)*)? (',' set)* | (param ',')* set (',' set)* (',' '/' (',' set)*)? ;
param = ID (':' expr)? ;
set = param '=' expr ;
star = '*' (ID (':' starexpr)? (',' param ('=' expr)?)* | (',' param ('=' expr)?)+) (',' '**' param)? | '**' param ;
class = 'class' ID typeparams? ('(' (arglist ','?)? ')')? ':' block ;
decorated = ('@' expr NL)+ (def | class | 'async' def) ;
match = 'match' starexprs ':' NL INDENT NL* ('case' pattern ('if' expr)? ':' block NL*)+ DEDENT ;
pattern = starexprs | pat (',' pat)* ','? ;
pat = '*' ID | por ('as' ID)? ;
por = pone ('|' pone)* ;
pone = '-'? NUM | STR+ | 'None' | 'True' | 'False' | dotted ('(' (parg (',' parg)* ','?)? ')')? | '(' (pat (',' pat)* ','?)? ')' | '[' (pat (',' pat)* ','?)? ']' | '{' (pkey (',' pkey)* ','?)? '}' ;
parg = ID '=' pat | pat ;
pkey = '**' ID | pone ':' pat ;
BIN = 'or' ;
"""

_PY_BIN = "'in' | 'not' 'in' | 'is' 'not'? | '<' | '>' | '<=' | '>=' | '==' | '!=' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'"
_PY_AUG = "'+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**='"
# words that are keywords only in their place
PYTHON = re.sub(r"\bID\b", "name", PYTHON) + "name = ID | 'type' | 'match' | 'case' ;\n"
PYTHON = PYTHON.replace("BIN = 'or' ;", f"binop = {_PY_BIN} ; augop = {_PY_AUG} ;").replace("(BIN ", "(binop ").replace("AUG ", "augop ")

TYPESCRIPT = r"""
file = sep* (stmt sep*)* ;
sep = NL | ';' ;
semi = NL | ';' ;
nl = NL ;
block = '{' stmts '}' ;
stmts = sep* (item sep*)* ;
-- a statement that needs its end, or one that closes itself
item = closed | open semi | open ;
stmt = closed | open semi | open ;
closed = block | 'if' '(' exprs ')' nl? body ('else' nl? body)? | loops | 'switch' '(' exprs ')' '{' (('case' exprs | 'default') ':' stmts)* '}'
  | 'try' block ('catch' ('(' pattern (':' type)? ')')? block ('finally' block)? | 'finally' block) | function | class | interface | enum | module | exportclosed | ID ':' nl? stmt
  | decorator nl? (class | 'export' 'default'? class) ;
body = closed | open semi | open | ';' ;
loops = 'for' 'await'? '(' forhead ')' nl? body | 'while' '(' exprs ')' nl? body | 'do' nl? body nl? 'while' '(' exprs ')' semi? | 'with' '(' exprs ')' body ;
forhead = forinit? ';' exprs? ';' exprs? | (declkw? pattern | postfix) ('of' | 'in') exprs ;
forinit = declkw binding (',' binding)* | exprs ;
declkw = 'var' | 'let' | 'const' ;
open = vars | exprs | 'return' exprs? | 'throw' exprs | 'break' ident? | 'continue' ident? | 'debugger' | imports | exports | typealias | doless ;
doless = 'declare' (vars | function | class | module | enum | fnsig | interface | typealias) | 'abstract' 'class' classrest | fnsig ;
vars = declkw binding (',' binding)* ;
binding = pattern '!'? (':' type)? ('=' expr)? ;
pattern = ident | '[' (pelem? (',' pelem?)*) ']' | '{' (pprop (',' pprop)* ','?)? '}' ;
pelem = '...'? pattern ('=' expr)? ;
pprop = '...' pattern | propname ':' pattern ('=' expr)? | ident ('=' expr)? ;
imports = 'import' (STR | 'type'? importclause 'from' STR | ident '=' exprs) importattr? ;
importattr = 'with' object ;
importclause = ident (',' (namedimports | '*' 'as' ident))? | namedimports | '*' 'as' ident ;
namedimports = '{' (importname (',' importname)* ','?)? '}' ;
importname = 'type'? name ('as' name)? ;
exports = 'export' (vars | typealias | doless | '*' ('as' name)? 'from' STR | 'type'? namedimports ('from' STR)? | 'default' expr | '=' expr | imports) ;
exportclosed = 'export' ('default'? function | 'default'? class | interface | enum | module | 'default' 'abstract' class | 'declare' (function | class | enum | module)) | 'declare' (class | module | enum | interface) ;
typealias = 'type' ident typeparams? '=' type ;
interface = 'interface' ident typeparams? ('extends' typelist)? objtype ;
enum = 'const'? 'enum' ident '{' (enummember (',' enummember)* ','?)? '}' ;
enummember = propname ('=' expr)? ;
module = ('namespace' | 'module') (dotted | STR) block ;
dotted = ident ('.' ident)* ;
function = 'async'? 'function' '*'? ident? sig block ;
fnsig = 'async'? 'function' '*'? ident sig ;
sig = typeparams? '(' params? ')' (':' rettype)? ;
rettype = type | ident 'is' type | 'this' 'is' type | 'asserts' (ident | 'this') ('is' type)? ;
params = param (',' param)* ','? ;
param = decorator* modifier* '...'? (pattern | 'this') '?'? (':' type)? ('=' expr)? ;
modifier = 'public' | 'private' | 'protected' | 'readonly' | 'static' | 'abstract' | 'override' | 'declare' | 'async' | 'accessor' ;
decorator = '@' dotted typeargs? ('(' args? ')')? ;
class = 'abstract'? 'class' classrest ;
classrest = ident? typeparams? ('extends' postfix typeargs?)? ('implements' typelist)? '{' (sep | member)* '}' ;
member = decorator* nl? modifier* (('get' | 'set')? '*'? propname ('?' | '!')? (sig (block | semi | nl)? | (':' type)? ('=' expr)? ) | 'static' block | indexsig) ;
indexsig = '[' ident ':' type ']' ':' type ;
typelist = type (',' type)* ;
objtype = '{' (sep | ',')* (tmember (sep | ',')*)* '}' ;
tmember = ('readonly' | '+' 'readonly' | '-' 'readonly')? (('get' | 'set')? propname '?'? (sig | ':' type)? | indexsig '?'? | '[' ident 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)?) | 'new'? sig ;
typeparams = '<' typeparam (',' typeparam)* ','? '>' ;
typeparam = 'const'? 'in'? ident ('extends' type)? ('=' type)? ;
typeargs = '<' type (',' type)* ','? '>' ;
type = '|'? '&'? tunary (('|' | '&') tunary)* ('extends' type '?' type ':' type)? ;
tunary = ('keyof' | 'readonly' | 'unique' | 'infer')* tpost ;
tpost = tprim ('[' type? ']')* ;
tprim = dottedname typeargs? | STR | NUM | '-' NUM | 'null' | 'true' | 'false' | 'void' | 'this' | tplt | objtype | '[' (telem (',' telem)* ','?)? ']'
  | '(' type ')' | 'abstract'? 'new'? typeparams? '(' params? ')' '=>' rettype | 'typeof' postfixname | 'import' '(' type ')' ('.' name)* typeargs? ;
telem = '...'? (ident '?'? ':')? type '?'? ;
dottedname = ident ('.' name)* ;
postfixname = ('this' | ident | 'import' '(' STR ')') ('.' name | '[' type ']')* typeargs? ;
tplt = TPL | TPLHEAD type (TPLMID type)* TPLEND ;
exprs = expr (',' expr)* ;
expr = arrow | assign ;
assign = binary ('?' expr ':' expr)? ;
binary = unary (binop unary | ('as' | 'satisfies') (type | 'const'))* ;
arrow = 'async'? (ident | typeparams? '(' params? ')' (':' rettype)?) '=>' (expr | block) ;
unary = (('!' | '-' | '+' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await')* postfix) | 'yield' ('*'? expr)? | ('!' | 'await' | 'void' | 'typeof')+ arrow ;
binop = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>' '=' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof'
  | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
postfix = primary tail* ;
tail = '.' (name | PRIVATE) | '?.' (name | PRIVATE | '[' exprs ']' | '(' args? ')') | '[' exprs ']' | typeargs? '(' args? ')' | '!' | '++' | '--' | tpl ;
primary = ident | NUM | STR | REGEX | PRIVATE | tpl | 'this' | 'super' | 'null' | 'true' | 'false' | '(' exprs ')' | array | object | funcexpr | class | 'new' ('.' name | postfix typeargs?) | 'import' ('(' args ')' | '.' name) | '<' type '>' postfix ;
funcexpr = 'async'? 'function' '*'? ident? sig block ;
tpl = TPL | TPLHEAD exprs (TPLMID exprs)* TPLEND ;
args = arg (',' arg)* ','? ;
arg = '...'? expr ;
array = '[' (arg? (',' arg?)*) ']' ;
object = '{' (prop (',' prop)* ','?)? '}' ;
prop = '...' expr | propname ':' expr | ident ('=' expr)? | ('get' | 'set' | 'async')? '*'? propname sig block ;
propname = name | STR | NUM | '[' expr ']' | PRIVATE ;
ident = ID | 'of' | 'as' | 'type' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'public' | 'private' | 'protected' | 'static' | 'get' | 'set' | 'is' | 'keyof' | 'infer' | 'implements' | 'satisfies' | 'from' | 'asserts' | 'override' | 'async' | 'accessor' | 'unique' | 'interface' | 'await' | 'let' | 'yield' ;
name = ident | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' ;
"""
# a statement without its end is admitted only before a closing brace or the end of the file
TYPESCRIPT = (
    TYPESCRIPT.replace("file = sep* (stmt sep*)* ;", "file = list ; list = sep* (closed sep* | open sep+)* open? ;")
    .replace("stmts = sep* (item sep*)* ;", "stmts = list ;")
    .replace("item = closed | open semi | open ;\n", "")
    .replace("body = closed | open semi | open | ';' ;", "body = closed | open ';'? | ';' ;")
)

RUST = r"""
file = HASHBANG? inner* item* ;
inner = HASH '!' '[' tt* ']' ;
attr = HASH '[' tt* ']' ;
tt = '(' tt* ')' | '[' tt* ']' | '{' tt* '}' | leaf ;
vis = 'pub' ('(' ('in'? path) ')')? ;
item = attr* vis? (fn | struct | enum | union | trait | impl | 'mod' ID (';' | '{' inner* item* '}') | 'use' usetree ';' | 'const' (ID | '_') ':' type ('=' expr)? ';' | 'static' 'mut'? ID ':' type ('=' expr)? ';'
  | 'type' ID generics? (':' bounds?)? where? ('=' type)? where? ';' | 'extern' 'crate' (ID | 'self') ('as' ID)? ';' | 'unsafe'? 'extern' STR? '{' item* '}' | macroitem) ;
macroitem = path '!' ID? ('(' tt* ')' ';' | '[' tt* ']' ';' | '{' tt* '}' ';'?) ;
usetree = '::'? (usepath ('as' ID)? | (usepath '::')? ('*' | '{' (usetree (',' usetree)* ','?)? '}')) ;
usepath = seg ('::' seg)* ;
seg = ID | 'self' | 'super' | 'crate' | 'Self' | 'union' ;
fn = 'default'? 'const'? 'async'? 'unsafe'? ('extern' STR?)? 'fn' (ID | 'union') generics? '(' fnparams? ')' ('->' type)? where? (block | ';') ;
fnparams = fnparam (',' fnparam)* ','? ;
fnparam = attr* ('&'? LIFE? 'mut'? 'self' (':' type)? | '&' LIFE 'mut'? 'self' | pat ':' type | '...') ;
struct = 'struct' ID generics? (where? '{' fields? '}' | '(' tfields? ')' where? ';' | where? ';') ;
union = 'union' ID generics? where? '{' fields? '}' ;
fields = field (',' field)* ','? ;
field = attr* vis? ID ':' type ;
tfields = tfield (',' tfield)* ','? ;
tfield = attr* vis? type ;
enum = 'enum' ID generics? where? '{' (variant (',' variant)* ','?)? '}' ;
variant = attr* vis? ID ('{' fields? '}' | '(' tfields? ')')? ('=' expr)? ;
trait = 'unsafe'? 'trait' ID generics? (':' bounds?)? where? '{' inner* item* '}' ;
impl = 'default'? 'unsafe'? 'impl' generics? ('!'? type 'for')? type where? '{' inner* item* '}' ;
generics = '<' (gparam (',' gparam)* ','?)? '>' ;
gparam = attr* (LIFE (':' lifes)? | 'const' ID ':' type ('=' (lit | block | ID))? | ID (':' bounds?)? ('=' type)?) ;
lifes = LIFE ('+' LIFE)* ;
bounds = bound ('+' bound)* '+'? ;
bound = LIFE | '?'? ('for' generics)? '?'? path | '(' bound ')' ;
where = 'where' (wpred (',' wpred)* ','?)? ;
wpred = LIFE ':' lifes? | ('for' generics)? type ':' bounds? ;
path = '::'? pseg ('::' pseg)* ;
pseg = seg targs? | seg '(' (type (',' type)* ','?)? ')' ('->' type)? | seg '::' targs ;
targs = '<' (targ (',' targ)* ','?)? '>' ;
targ = LIFE | type | ID targs? '=' type | ID targs? ':' bounds | lit | '-' lit | block ;
qpath = '<' type ('as' path)? '>' ('::' pseg)+ ;
type = path ('!' ('(' tt* ')' | '[' tt* ']' | '{' tt* '}'))? | qpath | ('&' | '&&') LIFE? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']' | '(' (type (',' type)* ','?)? ')' | '!' | '_'
  | ('for' generics)? 'unsafe'? ('extern' STR?)? 'fn' '(' (attr* ((ID | '_') ':')? type (',' attr* ((ID | '_') ':')? type)* ','?)? (',' '...')? ')' ('->' type)? | ('impl' | 'dyn') bounds ;
block = '{' inner* stmts '}' ;
stmts = (';' | stmt)* expr? ;
stmt = letst | item | attr* expr ';' | attr* blocky ;
letst = attr* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' ;
blocky = (LIFE ':')? ('unsafe' | 'async' 'move'?)? block | ifx | matchx | (LIFE ':')? ('loop' block | 'while' cond block | 'for' pat 'in' expr block) | 'const' block | path '!' '{' tt* '}' ;
ifx = 'if' cond block ('else' (ifx | block))? ;
cond = expr ;
matchx = 'match' expr '{' inner* arms '}' ;
arms = (arm ',' | blockarm ','?)* arm? ;
armhead = attr* '|'? pat ('if' cond)? '=>' ;
arm = armhead expr ;
blockarm = armhead blocky ;
expr = unary (binop unary | 'as' type)* ((('..' | '..=') (unary (binop unary | 'as' type)*)?))? | ('..' | '..=') (unary (binop unary)*)? | 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | closure | 'let' pat '=' expr ;
binop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>' '=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '..' | '..=' ;
unary = ('-' | '!' | '*' | ('&' | '&&') ('mut' | 'raw' 'const')?)* (postfix | closure | 'return' expr? | 'break' LIFE? | 'let' pat '=' unary) ;
postfix = primary ('?' | '.' ('await' | ID ('::' targs)? | NUM | 'union') | '(' args? ')' | '[' expr ']')* ;
args = attr* expr (',' attr* expr)* ','? ;
primary = lit | epath | epath '!' ('(' tt* ')' | '[' tt* ']' | '{' tt* '}') | epath '{' (finit (',' finit)* ','?)? (','? '..' expr?)? '}' | qpath | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (';' expr | (',' expr)* ','?)?)? ']' | blocky | '_' ;
epath = '::'? seg ('::' (seg | targs))* ;
finit = attr* (ID | NUM) (':' expr)? ;
closure = 'static'? 'async'? 'move'? ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type block | expr) ;
cparam = patone (':' type)? ;
lit = NUM | STR | 'true' | 'false' ;
pat = '|'? patone ('|' patone)* ;
patone = patrange | 'ref'? 'mut'? ID ('@' patone)? | '_' | '..' | ('&' | '&&') 'mut'? patone | '(' (pat (',' pat)* ','?)? ')' | '[' (pat (',' pat)* ','?)? ']' | epath ('(' (pat (',' pat)* ','?)? ')' | '{' (fpat (',' fpat)* ','?)? '}')? | qpath | 'box' patone | epath '!' '(' tt* ')' ;
patrange = '-'? lit (('..' | '..=' | '...') ('-'? lit | epath)?)? | epath ('..' | '..=') ('-'? lit | epath)? | '..=' '-'? lit ;
fpat = attr* ('..' | (ID | NUM) ':' pat | 'ref'? 'mut'? ID) ;
"""

GO = r"""
file = ';'* 'package' ID ';' ';'* ('import' importspec ';' ';'*)* (top ';' ';'*)* top? ;
importspec = importone | '(' ';'* (importone ';')* importone? ')' ;
importone = (ID | '.')? STR ;
top = decl | 'func' ID typeparams? signature block? | 'func' '(' receiver ')' ID signature block? ;
receiver = params ;
decl = 'const' group_const | 'var' group_var | 'type' group_type ;
group_const = constspec | '(' ';'* (constspec ';')* constspec? ')' ;
constspec = idlist (type? '=' exprs)? ;
group_var = varspec | '(' ';'* (varspec ';')* varspec? ')' ;
varspec = idlist (type ('=' exprs)? | '=' exprs) ;
group_type = typespec | '(' ';'* (typespec ';')* typespec? ')' ;
typespec = ID typeparams? '='? type ;
typeparams = '[' tparam (',' tparam)* ','? ']' ;
tparam = idlist union ;
union = '~'? type ('|' '~'? type)* ;
idlist = ID (',' ID)* ;
type = typename | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' signature | struct | interface | '(' type ')' ;
typename = ID ('.' ID)? ('[' type (',' type)* ','? ']')? ;
struct = 'struct' '{' ';'* (field ';' ';'*)* field? '}' ;
field = idlist type STR? | '*'? typename STR? ;
interface = 'interface' '{' ';'* (ielem ';' ';'*)* ielem? '}' ;
ielem = ID signature | union ;
signature = '(' params? ')' result? ;
result = '(' params? ')' | type ;
params = param (',' param)* ','? ;
param = ID? '...'? type ;
block = '{' stmts '}' ;
stmts = ';'* (stmt ';' ';'*)* stmt? ;
stmt = decl | simple | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | 'defer' expr | 'go' expr | block | ifst | forst | switchst | selectst | ID ':' ';'* stmt? ;
simple = exprs (assignop exprs | '++' | '--' | '<-' expr)? ;
assignop = '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
ifst = 'if' (simple? ';')? expr block ('else' (ifst | block))? ;
forst = 'for' (expr? | simple? ';' expr? ';' simple? | (exprs ('=' | ':='))? 'range' expr) block ;
switchst = 'switch' (simple? ';')? simple? '{' ';'* clause* '}' ;
clause = ('case' casexprs | 'default') ':' stmts ;
casexprs = caseone (',' caseone)* ;
caseone = expr | type ;
selectst = 'select' '{' ';'* (('case' simple | 'default') ':' stmts)* '}' ;
exprs = expr (',' expr)* ;
expr = unary (binop unary)* ;
binop = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* primary ;
primary = operand ('.' (ID | '(' (type | 'type') ')') | '[' index ']' | '(' args? ')' | literal)* ;
index = expr? (':' expr?)? (':' expr)? | type (',' type)* ','? ;
args = (arg (',' arg)*) ','? ;
arg = (expr | type) '...'? ;
operand = NUM | STR | ID | '(' (expr | type) ')' | 'func' signature block | littype literal | littype '(' args? ')' ;
littype = '[' (expr | '...')? ']' type | 'map' '[' type ']' type | struct | 'chan' '<-'? type | interface ;
literal = '{' ';'* (elem (',' elem)* ','? )? '}' ;
elem = (value ':')? value ;
value = expr | literal ;
"""

JAVA = r"""
file = (annotation* 'package' dotted ';')? (('import' 'static'? dotted ('.' '*')? ';') | ';')* (typedecl | ';' | method | fieldtop)* ;
fieldtop = mods type declarators ';' ;
dotted = ident ('.' ident)* ;
ident = ID | 'record' | 'yield' | 'sealed' | 'permits' | 'var' ;
annotation = '@' dotted ('(' (annargs)? ')')? ;
annargs = annval (',' annval)* ','? ;
annval = (ident '=')? (expr | annarray | annotation) ;
annarray = '{' ((expr | annarray | annotation) (',' (expr | annarray | annotation))*)? ','? '}' ;
mods = (annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | ID '-' 'sealed')* ;
typedecl = mods (class | interface | enum | record | annotype) ;
class = 'class' ident typeparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody ;
interface = 'interface' ident typeparams? ('extends' types)? ('permits' types)? classbody ;
annotype = '@' 'interface' ident '{' (mods type ident '(' ')' dims ('default' annval)? ';' | mods type declarators ';' | typedecl | ';')* '}' ;
enum = 'enum' ident ('implements' types)? '{' (econst (',' econst)* ','?)? (';' member*)? '}' ;
econst = annotation* ident ('(' args? ')')? classbody? ;
record = 'record' ident typeparams? '(' params? ')' ('implements' types)? classbody ;
classbody = '{' member* '}' ;
member = ';' | typedecl | 'static'? block | method | mods type declarators ';' | mods typeparams? ident params_ throws? block | mods ident block ;
method = mods typeparams? annotation* (type | 'void') ident params_ dims throws? (block | ';') ;
params_ = '(' params? ')' ;
throws = 'throws' types ;
params = param (',' param)* ;
param = (annotation | 'final')* type annotation* '...'? (ident dims | (ident '.')? 'this') ;
dims = ('[' ']')* ;
types = type (',' type)* ;
typeparams = '<' typeparam (',' typeparam)* '>' ;
typeparam = annotation* ident ('extends' type ('&' type)*)? ;
type = annotation* (prim | classtype) (annotation* '[' ']')* ;
prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' ;
classtype = ident targs? ('.' annotation* ident targs?)* ;
targs = '<' (targ (',' targ)*)? '>' ;
targ = type | annotation* '?' (('extends' | 'super') type)? ;
declarators = declarator (',' declarator)* ;
declarator = ident dims ('=' init)? ;
init = expr | '{' (init (',' init)*)? ','? '}' ;
block = '{' bstmt* '}' ;
bstmt = local ';' | typedecl | stmt ;
local = (annotation | 'final')* type declarators ;
stmt = block | ';' | 'if' par stmt ('else' stmt)? | 'while' par stmt | 'do' stmt 'while' par ';' | 'for' '(' forhead ')' stmt | switch | 'return' expr? ';' | 'break' ident? ';' | 'continue' ident? ';' | 'throw' expr ';' | 'yield' expr ';'
  | 'synchronized' par block | try | 'assert' expr (':' expr)? ';' | ident ':' stmt | stmtexpr ';' ;
par = '(' expr ')' ;
forhead = (local | exprs)? ';' expr? ';' exprs? | (annotation | 'final')* type ident ':' expr ;
exprs = expr (',' expr)* ;
try = 'try' '(' resource (';' resource)* ';'? ')' block catch* finally? | 'try' block (catch+ finally? | finally) ;
catch = 'catch' '(' 'final'? annotation* type ('|' type)* ident ')' block ;
finally = 'finally' block ;
resource = 'final'? type ident '=' expr | expr ;
switch = 'switch' par '{' (slabel+ bstmt* | sarrow)* '}' ;
slabel = ('case' caseval (',' caseval)* | 'default') ':' ;
sarrow = ('case' caseval (',' caseval)* | 'default') '->' (expr ';' | block | 'throw' expr ';') ;
caseval = ternary | pattern ('&&' expr)? | 'default' | 'null' ;
pattern = 'final'? type ident | type '(' (pattern (',' pattern)*)? ')' ident? ;
stmtexpr = (pre* primary tail+ | pre+ primary) (assignop expr)? | primary assignop expr | 'new' newrest tail* ;
pre = '++' | '--' ;
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' ;
expr = lambda | ternary (assignop expr)? ;
ternary = binary ('?' expr ':' (lambda | ternary))? ;
binary = unary (binop unary | 'instanceof' ('final'? type ident? | pattern))* ;
binop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' ;
unary = ('+' | '-' | '!' | '~' | '++' | '--')* (cast | primary tail*) | switch ;
cast = '(' type ('&' type)* ')' (unary | lambda) ;
lambda = (ident | '(' (lparams)? ')') '->' (expr | block) ;
lparams = ident (',' ident)* | params ;
primary = ident | NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | 'new' newrest | (prim | 'void') dims '.' 'class' | prim dims '::' 'new' | classtype ('[' ']')+ ('.' 'class' | '::' 'new') | classtype '::' targs? (ident | 'new') ;
newrest = annotation* classtype '(' args? ')' classbody? | annotation* (prim | classtype) (('[' expr ']')+ dims | ('[' ']')+ arrayinit) ;
arrayinit = '{' (init (',' init)*)? ','? '}' ;
tail = '.' (targs? (ident | 'super') | 'this' | 'class' | 'new' newrest) | '[' expr ']' | '(' args? ')' | '++' | '--' | '::' targs? (ident | 'new') ;
args = expr (',' expr)* ;
"""

C = r"""
file = (ext | ';')* ;
ext = attrs specs declarator decl1 compound | declarator compound | attrs declaration | 'asm' '(' STR+ ')' ';' ;
decl1 = declaration* ;
attrs = attribute* ;
attribute = '[' '[' any* ']' ']' ;
any = ID | NUM | STR | ',' | '(' any* ')' | ':' ':' ;
declaration = specs (initd (',' initd)*)? ';' ;
specs = spec+ ;
spec = lspec | ID '(' any* ')' ;
lspec = 'auto' | 'char' | 'const' | 'double' | 'extern' | 'float' | 'inline' | 'int' | 'long' | 'register' | 'restrict' | 'short' | 'signed' | 'static' | 'typedef' | 'unsigned' | 'void' | 'volatile' | ID | aggregate | enum | attribute ;
aggregate = ('struct' | 'union') attrs ID? ('{' (specs (sdecl (',' sdecl)*)? ';' | ';')* '}')? ;
sdecl = declarator (':' cond)? | ':' cond ;
enum = 'enum' ID? (':' specs)? ('{' ID ('=' cond)? (',' ID ('=' cond)?)* ','? '}')? ;
initd = declarator ('=' init)? ;
init = expr | '{' (initem (',' initem)* ','?)? '}' ;
initem = (('.' ID | '[' cond ('...' cond)? ']')+ '=')? init ;
declarator = ('*' qual*)* direct ;
qual = 'const' | 'volatile' | 'restrict' | ID ;
direct = (ID | '(' declarator ')') dsuffix* ;
dsuffix = '[' 'static'? qualk* (cond | '*')? ']' | '(' (params | ID (',' ID)*)? ')' | attribute ;
qualk = 'const' | 'volatile' | 'restrict' ;
params = param (',' param)* (',' '...')? | '...' ;
param = attrs specs (declarator | abstract)? ;
abstract = ('*' qualk*)+ adirect? | adirect ;
adirect = ('(' abstract ')' | asuffix) asuffix* ;
asuffix = '[' (cond | '*')? ']' | '(' params? ')' ;
typename = locals abstract? ;
compound = '{' (local | stmt)* '}' ;
-- a call before a declarator is a macro outside functions; inside them it is a call that lost its semicolon
local = locals (initd (',' initd)*)? ';' ;
locals = (lspec | SPECIFIER '(' (typename | exprs | any*) ')')+ ;
stmt = compound | ';' | exprs ';' | ID ':' stmt? | 'case' cond ('...' cond)? ':' stmt? | 'default' ':' stmt? | 'if' '(' exprs ')' stmt ('else' stmt)? | 'switch' '(' exprs ')' stmt | 'while' '(' exprs ')' stmt
  | 'do' stmt 'while' '(' exprs ')' ';' | 'for' '(' (local | exprs? ';') exprs? ';' exprs? ')' stmt | 'goto' ID ';' | 'continue' ';' | 'break' ';' | 'return' exprs? ';' | attribute+ stmt ;
exprs = expr (',' expr)* ;
expr = binary ('?' exprs? ':' expr)? (assignop expr)? ;
cond = binary ('?' exprs? ':' expr)? ;
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' ;
binary = unary (binop unary)* ;
binop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>' ;
unary = ('+' | '-' | '!' | '~' | '*' | '&' | '++' | '--')* (cast | postfix | 'sizeof' ('(' typename ')' | unary)) ;
cast = '(' typename ')' (unary | '{' (initem (',' initem)* ','?)? '}') ;
postfix = primary ('[' exprs ']' | '(' args? ')' | '.' ID | '->' ID | '++' | '--')* ;
args = arg (',' arg)* ;
arg = expr | typename ;
primary = ID | NUM | (STR | ID STR)+ ID? | '(' exprs ')' | '(' compound ')' ;
"""

C = re.sub(r"\bID\b", "id", C) + "id = ID | SPECIFIER ;\n"

CPP = r"""
file = top* ;
top = ';' | namespace | 'extern' STR ('{' top* '}' | top) | template | using | 'static_assert' '(' exprs ')' ';' | attribute* (function | declaration) | 'inline' namespace | concept ;
attribute = '[' '[' any* ']' ']' | 'alignas' '(' exprs ')' ;
any = ID | NUM | STR | ',' | '::' | '(' any* ')' ;
namespace = 'namespace' attribute* (ID ('::' 'inline'? ID)*)? '{' top* '}' | 'namespace' ID '=' name ';' ;
using = 'using' ('namespace' name | 'typename'? name (',' 'typename'? name)* | ID attribute* '=' typename) ';' ;
template = 'template' ('<' (tparam (',' tparam)*)? '>')? requires? (function | declaration | using | template | concept | friend) ;
concept = 'template' '<' (tparam (',' tparam)*)? '>' 'concept' ID '=' exprs ';' ;
requires = 'requires' (primary | ID ('::' ID)* targs?) (('&&' | '||') (primary | ID ('::' ID)* targs?))* ;
tparam = ('typename' | 'class') '...'? ID? ('=' typename)? | 'template' '<' (tparam (',' tparam)*)? '>' ('class' | 'typename') '...'? ID? ('=' name)? | specs '...'? (declarator | abstract)? ('=' cond)? ;
function = specs? fdeclarator fsuffix ctorinit? (compound | tryblock | '=' ('default' | 'delete' | NUM) ';') | specs? fdeclarator fsuffix ';' ;
fdeclarator = ptr* (name | '~' ID | name '::' '~' ID | (name '::')? operator | conv) '(' params? ')' ;
conv = (name '::')? 'operator' specs ptr* ;
operator = 'operator' ('+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '~' | '!' | '=' | '<' | '>' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<' | '>' '>' | '<<=' | '>' '>=' | '==' | '!=' | '<=' | '>=' | '<=>' | '&&' | '||' | '++' | '--' | ',' | '->*' | '->' | '(' ')' | '[' ']' | 'new' ('[' ']')? | 'delete' ('[' ']')? | STR ID) ;
fsuffix = ('const' | 'volatile' | '&' | '&&' | 'noexcept' ('(' cond ')')? | 'override' | 'final' | 'throw' '(' (typename (',' typename)*)? ')' | '->' typename | attribute | requires)* ;
ctorinit = ':' minit (',' minit)* ;
minit = name ('(' args? ')' | braced) '...'? ;
tryblock = 'try' ctorinit? compound handler+ ;
handler = 'catch' '(' (specs (declarator | abstract)? | '...') ')' compound ;
declaration = specs (initd (',' initd)*)? ';' | 'friend' (function | declaration) | using | 'static_assert' '(' exprs ')' ';' ;
friend = 'friend' (function | declaration) ;
specs = spec+ ;
spec = 'auto' | 'bool' | 'char' | 'const' | 'constexpr' | 'double' | 'extern' | 'float' | 'inline' | 'int' | 'long' | 'mutable' | 'register' | 'short' | 'signed' | 'static' | 'typedef' | 'unsigned' | 'virtual' | 'void' | 'volatile' | 'explicit' ('(' cond ')')? | 'typename' name | name | class | enum | 'decltype' '(' exprs ')' | attribute | 'class' name | 'struct' name | 'union' name | 'enum' name ;
name = '::'? ID targs? ('::' 'template'? ID targs?)* ;
targs = '<' (targ (',' targ)*)? '>' ;
targ = typename '...'? | tcond '...'? ;
tcond = unary (tbinop unary)* ;
tbinop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' ;
class = ('class' | 'struct' | 'union') attribute* name? 'final'? (':' base (',' base)*)? '{' member* '}' ;
base = ('virtual' | 'public' | 'private' | 'protected')* name '...'? ;
member = ('public' | 'private' | 'protected') ':' | ';' | template | attribute* (function | mdecl) ;
mdecl = specs (mdeclarator (',' mdeclarator)*)? ';' | 'friend' (function | declaration) | using | 'static_assert' '(' exprs ')' ';' ;
mdeclarator = declarator fsuffix (':' cond)? ('=' init | braced)? | ':' cond ;
enum = 'enum' ('class' | 'struct')? attribute* name? (':' specs)? '{' (ID ('=' cond)? (',' ID ('=' cond)?)* ','?)? '}' ;
initd = declarator fsuffix ('=' init | braced | '(' args ')')? ;
init = expr | braced ;
braced = '{' (binit (',' binit)* ','?)? '}' ;
binit = ('.' ID ('=' init | braced)) | init '...'? ;
ptr = '*' ('const' | 'volatile')* | '&' | '&&' | name '::' '*' ;
declarator = ptr* '...'? direct ;
direct = (name | '(' declarator ')' | '[' ID (',' ID)* ']') dsuffix* ;
dsuffix = '[' cond? ']' | '(' params? ')' ;
params = param (',' param)* (','? '...')? | '...' ;
param = attribute* specs '...'? (declarator | abstract)? ('=' init)? ;
abstract = ptr+ adirect? | adirect ;
adirect = ('(' abstract ')' | asuffix) asuffix* ;
asuffix = '[' cond? ']' | '(' params? ')' ;
typename = specs abstract? ;
compound = '{' bstmt* '}' ;
bstmt = declaration | stmt ;
stmt = attribute* (compound | ';' | exprs ';' | ID ':' stmt? | 'case' cond ('...' cond)? ':' | 'default' ':' | 'if' ('constexpr' | '!'? ID)? '(' ifcond ')' stmt ('else' stmt)? | 'switch' '(' ifcond ')' stmt | 'while' '(' ifcond ')' stmt
  | 'do' stmt 'while' '(' exprs ')' ';' | 'for' '(' forhead ')' stmt | 'goto' ID ';' | 'continue' ';' | 'break' ';' | ('return' | 'co_return') (exprs | braced)? ';' | 'try' compound handler+) ;
ifcond = (declaration | exprs? ';')? (exprs | specs declarator ('=' init | braced)) ;
forhead = (declaration | exprs? ';') exprs? ';' exprs? | (declaration | exprs ';')? attribute* specs declarator ':' (exprs | braced) ;
exprs = expr (',' expr)* ;
expr = binary ('?' exprs? ':' expr)? (assignop init)? | 'throw' expr? | 'co_yield' expr ;
cond = binary ('?' exprs? ':' expr)? ;
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' ;
binary = unary (binop unary)* ;
binop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '<=>' | '.*' | '->*' ;
unary = ('+' | '-' | '!' | '~' | '*' | '&' | '&&' | '++' | '--' | 'co_await')* (cast | postfix | ('sizeof' | 'alignof') '...'? ('(' (typename | exprs) ')' | unary) | new | '::'? 'delete' ('[' ']')? unary | 'noexcept' '(' exprs ')') ;
new = '::'? 'new' ('(' args ')')? ('(' typename ')' | specs ptr* ('[' exprs ']')*) ('(' args? ')' | braced)? ;
cast = '(' typename ')' unary ;
postfix = primary ('[' (exprs | braced) ']' | '(' args? ')' | ('.' | '->') 'template'? (name | '~' ID | operator) | '++' | '--' | braced)* ;
args = arg (',' arg)* ;
arg = init '...'? ;
primary = name | NUM | STR+ | 'this' | 'true' | 'false' | 'nullptr' | '(' exprs ')' | '(' (exprs | '...') binop ('...' | exprs) (binop exprs)? ')' | lambda | ('static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast') '<' typename '>' '(' exprs ')' | 'typeid' '(' (typename | exprs) ')'
  | simpletype ('(' args? ')' | braced) | 'typename' name ('(' args? ')' | braced) | (name '::')? operator | 'decltype' '(' exprs ')' (braced | '(' args? ')') | 'requires' ('(' params? ')')? compound ;
simpletype = 'int' | 'bool' | 'char' | 'double' | 'float' | 'long' | 'short' | 'unsigned' | 'signed' | 'void' | 'auto' ;
lambda = '[' (capture (',' capture)*)? ']' ('<' tparam (',' tparam)* '>')? ('(' params? ')')? ('mutable' | 'constexpr' | 'noexcept' | '->' typename | attribute)* compound ;
capture = '=' | '&' | '&'? ID '...'? ('=' init)? | '*'? 'this' ;
"""

RUBY = r"""
-- Statements, arguments and operators are written so that no two alternatives begin with the same long phrase: what an ambiguity encloses would be followed
-- once for each way out of it. Operators bind to the right without precedence, a command takes all that follows it, and after a value or a jump
-- the words if, unless, while and until are always modifiers.
file = stmts ;
sep = NL | ';' ;
stmts = sep* (stmt (sep+ stmt)* sep*)? ;
stmt = full (('if' | 'unless' | 'while' | 'until' | 'rescue') full)* | 'alias' (fname fname) | 'undef' fname | ('BEGIN' | 'END') '{' stmts '}' ;
full = chain (('and' | 'or') chain)* ;
chain = jump | prefix+ after match? | postfix (several | etail match?) | argstar mone (',' mone)* '=' rhs | '(' mone (',' mone)+ ')' several | ('..' | '...') expr ;
several = (',' mone)+ ','? '=' rhs | ',' '=' rhs ;
match = ('=>' | 'in') pat ;
mone = argstar? postfix | '(' mone (',' mone)* ')' ;
argstar = 'ARG*' | '*' ;
rhs = splat (',' splat)* ;
splat = argstar? expr ;
expr = prefix* after | ('..' | '...') expr ;
after = jump | postfix etail ;
prefix = '!' | '-' | '+' | '~' | 'ARG-' | 'defined?' | 'not' ;
etail = (binop nls argstar? expr | '?' nls expr nls (':' nls expr | SYM) | cargs | '..' | '...')? ;
binop = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '=~' | '!~' | '<' | '>' | '<=' | '>=' | '<=>' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>' | '..' | '...' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '||=' | '&&=' | '|=' | '&=' | '^=' | '<<=' | '>>=' ;
postfix = primary tail* ;
tail = ('.' | '&.') nls (ID | CONST) callargs? | '.' callargs | '::' (CONST | ID) callargs? | 'AT[' args? ']' | callargs | block ;
callargs = 'CALL(' args? ')' ;
-- arguments without parentheses
cargs = carg0 (',' nls carg)* ;
carg0 = (word | cword) tail* etail ('=>' nls expr)? | ('ARG*' | 'ARG&' | 'ARG**' | 'ARG-' | '!' | 'defined?' | 'not') expr | 'ARG::' CONST tail* etail | '[' args? ']' tail* etail | LABEL nls expr? ;
carg = expr ('=>' nls expr)? | LABEL nls expr? | ('ARG*' | 'ARG&' | 'ARG**' | '*' | '&' | '**') expr ;
args = nls arg (',' nls arg)* ','? nls ;
arg = expr ('=>' nls expr)? | LABEL nls expr? | ('ARG*' | '*' | 'ARG**' | '**' | 'ARG&' | '&') expr? ;
jump = ('return' | 'break' | 'next') (jarg0 (',' nls carg)*)? ;
jarg0 = carg0 | '{' hash? '}' tail* etail | ('-' | '+' | '~' | '*' | '&' | '**') expr | '::' CONST tail* etail | ('..' | '...') expr ;
nls = NL* ;
block = 'do' blockparams? stmts rescues 'end' | '{' blockparams? stmts '}' ;
blockparams = NL? '|' (bparams)? (';' ID (',' ID)*)? '|' | '||' ;
bparams = bparam (',' bparam)* ','? ;
bparam = ('ARG*' | '*' | 'ARG**' | '**' | 'ARG&' | '&')? ID ('=' bdefault)? | '(' bparams ')' | LABEL bdefault? | 'ARG*' | '*' ;
bdefault = prefix* postfix ;
word = ID | CONST | NUM | str | SYM | IVAR | REGEX | 'self' | 'nil' | 'true' | 'false' | '(' stmts ')' | '->' lparams? block | 'yield' | 'super' | 'redo' | 'retry' ;
primary = word | 'ARG::' CONST | '{' hash? '}' | '[' args? ']' | '::' CONST | cword | if | unless | whiles | for ;
cword = def | class | module | case | begin ;
str = STR+ ;
hash = nls (hpair (',' nls hpair)* ','?)? nls ;
hpair = LABEL nls expr? | expr nls '=>' nls expr | ('**' | 'ARG**') expr ;
lparams = '(' params? ')' | 'CALL(' params? ')' | params ;
rescues = ('rescue' (rtypes? ('=>' postfix)?) ('then' | sep) stmts)* ('else' stmts)? ('ensure' stmts)? ;
body = stmts rescues ;
rtypes = splat (',' splat)* ;
def = 'def' defname (('CALL(' | '(') params? nls ')' (sep? body 'end' | '=' nls stmt) | params? sep body 'end' | '=' nls stmt) ;
defname = (('self' | CONST | ID | IVAR) '.')? fname ;
fname = ID '='? | CONST '='? | SYM | IVAR | 'AT[' ']' '='? | '[' ']' '='? | '+' | '-' | '*' | '/' | '%' | '**' | '==' | '===' | '!=' | '=~' | '!' | '<' | '>' | '<=' | '>=' | '<=>' | '<<' | '>>' | '&' | '|' | '^' | '~' | '+' '@' | '-' '@' | '`' | 'class' | 'end' ;
params = nls param (',' nls param)* ','? nls ;
param = ID ('=' expr)? | LABEL nls expr? | ('ARG*' | '*' | 'ARG**' | '**' | 'ARG&' | '&') (ID | 'nil')? | '(' params ')' | '...' ;
class = 'class' (cpath ('<' expr)? | '<<' expr) sep body 'end' ;
module = 'module' cpath sep stmts 'end' ;
cpath = '::'? CONST ('::' CONST)* ;
then = 'then' | sep+ 'then'? ;
if = 'if' stmt then stmts ('elsif' stmt then stmts)* ('else' stmts)? 'end' ;
unless = 'unless' stmt then stmts ('else' stmts)? 'end' ;
whiles = ('while' | 'until') stmt ('do' | sep) stmts 'end' ;
for = 'for' bparams 'in' expr ('do' | sep) stmts 'end' ;
case = 'case' stmt? sep* (('when' splat (',' nls splat)* then stmts)+ | ('in' pat (('if' | 'unless') expr)? then stmts)+) ('else' stmts)? 'end' ;
pat = ptop (',' ptop)* ;
ptop = pone ('|' pone)* ('=>' ID)? | LABEL ptop? | ('ARG*' | '*' | '**' | 'ARG**') (ID | 'nil')? ;
pone = primary (('..' | '...') primary?)? | 'AT[' pat? ']' | '^' (ID | '(' expr ')') | '[' pat? ']' | '{' nls pat? nls '}' | CONST ('CALL(' | '(' | 'AT[') pat? (')' | ']') ;
begin = 'begin' body 'end' ;
"""

BASH = r"""
file = list ;
sep = NL | ';' | '&' ;
nls = NL* ;
list = nls (andor (sepr | NL nls))* andor? ;
sepr = (';' | '&') nls ;
listn = nls andor ((sepr | NL+) andor)* (sepr | NL+)? ;
andor = pipeline (('&&' | '||') nls pipeline)* ;
pipeline = ('time' WORD?)? '!'* (command (('|' | '|&') nls command)*) ;
command = simple | compound redir* | function ;
redir = REDIR anyword ;
simple = (ASSIGN | redir)+ (cmdword (anyword | ASSIGN | redir)*)? | cmdword (anyword | ASSIGN | redir)* ;
cmdword = WORD | ']]' ;
anyword = WORD | ASSIGN | ']]' | '[[' | 'if' | 'then' | 'elif' | 'else' | 'fi' | 'for' | 'while' | 'until' | 'do' | 'done' | 'case' | 'esac' | 'function' | 'select' | 'time' | 'in' | '{' | '}' | '!' ;
compound = '{' listn '}' | '(' listn ')' | ARITH | test | 'if' listn 'then' listn ('elif' listn 'then' listn)* ('else' listn)? 'fi' | ('while' | 'until') listn 'do' listn 'done'
  | ('for' | 'select') anyword nls ('in' anyword* )? (';' | NL)? nls dogroup | 'for' ARITH (';' | NL)? nls dogroup | 'case' anyword nls 'in' nls caseitem* lastitem? 'esac' ;
dogroup = 'do' listn 'done' | '{' listn '}' ;
caseitem = '('? patterns ')' list (';;' | ';&' | ';;&') nls ;
lastitem = '('? patterns ')' list ;
patterns = anyword ('|' anyword)* ;
test = '[[' nls tor ']]' ;
tor = tand ('||' nls tand)* ;
tand = tnot ('&&' nls tnot)* ;
tnot = '!'* ('(' nls tor ')' | tword+) nls ;
tword = WORD | ASSIGN | REDIR | 'in' | 'if' | 'for' | 'while' | 'do' | 'done' | 'time' | 'case' | 'select' | 'function' | 'else' | 'then' | 'fi' | '{' | '}' | '(' tword* ('|' tword*)* ')' ;
function = 'function' anyword ('(' ')')? nls compound redir* | WORD '(' ')' nls compound redir* ;
"""


def _rust_leaves() -> str:
    """Every token that is no bracket, for macro bodies."""
    from lodeseek.llm.lexing import _OPERATORS, KEYWORDS

    kinds = {*KEYWORDS["rust"], *_OPERATORS["rust"].split(), *"-+*/%&|^~!=<>?:.,;@"}
    return "leaf = ID | NUM | STR | LIFE | HASH | '_' | '$' | " + " | ".join(f"'{k}'" for k in sorted(kinds)) + " ;"


TEXTS = {"python": PYTHON, "typescript": TYPESCRIPT, "go": GO, "java": JAVA, "c": C, "cpp": CPP, "ruby": RUBY, "bash": BASH}


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    if language == "rust":
        return Grammar(RUST.replace("HASHBANG? ", "").replace("'raw' 'const'", "ID 'const'") + _rust_leaves())
    return Grammar(TEXTS[language])
