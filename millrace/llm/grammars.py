"""Grammars of seven languages, for the parser in ``gll``.

They describe statements and bracket groups. A bracket group is one token that
bears the names of all rules its inside derives (in lower case). Identifiers
are ``x``, numbers ``n``, strings ``s``; operators that only stand between
operands are ``op``, compound assignments ``asg``, ``++`` and ``--`` ``inc``.
Each language lists, for each kind of bracket, the rules to try, and for the
file itself its start rules, one for each dialect.
"""

from __future__ import annotations

_JS_COMMON = """
Module = Item*
Script = Stmt*
Block = Stmt*
Item = Stmt | Import | Export
End = ";" | "^"
Import = "import" s With? End | "import" "type"? ImportWhat "from" s With? End
With = "with" obj
ImportWhat = x ("," (names | "*" "as" x))? | names | "*" "as" x
Export = "export" "default"? (Func | Class | Var | TsDecl) | "export" "default" Assign End | "export" "type"? names ("from" s)? End | "export" "*" ("as" x)? "from" s End
Names = (NameItem ("," NameItem)* ","?)?
NameItem = "type"? (x | s | "default") ("as" (x | s | "default"))?
Var = Binds End
Binds = ("var" | "let") Bind ("," Bind)* | "const" Const ("," Const)*
Const = Target TypeAnn ("=" Assign)? | Target "=" Assign
Bind = Target "!"? TypeAnn? ("=" Assign)?
Target = x | obj | arr
Func = "async"? "function" "*"? x? TypeParams? params TypeAnn? block
Class = Decorator* "class" x? TypeParams? ("extends" Post TypeArgs?)? ("implements" Types)? classbody
Decorator = "@" Post
Stmt = block | Var | Func | Class | TsDecl | ";" | Simple | If | "for" "await"? forhead Stmt | "while" paren Stmt | "do" Stmt "while" paren End | Try | "switch" paren switch | x ":" Stmt
If = "if" paren Stmt ("else" Stmt)?
Try = "try" block ("catch" params? block)? ("finally" block)?
Simple = Expr End | "return" Expr? End | "throw" Expr End | "break" x? End | "continue" x? End | "debugger" End
Expr = Assign ("," Assign)*
Assign = Arrow | "yield" "*"? Assign? | Cond (("=" | asg) Assign)?
Arrow = "async"? TypeParams? (x | params TypeAnn?) "=>" (Assign | block)
Cond = Bin ("?" Assign ":" Assign)?
Bin = Un (BinOp Un)* TsAs*
BinOp = op | "+" | "-" | "*" | "/" | "&" | "|" | "<" | ">" ">"? ">"? "="? | "in" | "instanceof"
Un = ("!" | "~" | "+" | "-" | inc | "typeof" | "void" | "delete" | "await" | "new")* Post
Post = Prim Tail* inc?
Tail = "." Name | "." "#" x | "?." (Name | args | index) | args | index | s | TypeArgs args | TsBang
Name = x | "default" | "catch" | "delete" | "finally" | "for" | "in" | "return" | "new" | "class" | "import" | "if" | "else" | "try" | "throw" | "typeof" | "function" | "export" | "extends" | "var" | "const" | "do" | "while" | "switch" | "case" | "break" | "continue" | "with" | "void" | "instanceof" | "await" | "yield" | "debugger" | "super"
Prim = x | n | s | paren | arr | obj | Func | Class | "super" | "import" ("." x | args) | "new" "." x
Paren = Expr
Args = (Arg ("," Arg)* ","?)?
Arg = "..."? Assign
Params = (Param ("," Param)* ","?)?
Param = Decorator* Mod* "..."? Target "?"? TypeAnn? ("=" Assign)?
Forhead = (Binds | Expr)? ";" Expr? ";" Expr? | ("var" | "let" | "const")? Target TypeAnn? ("of" | "in") Expr
Arr = ((Arg)? ",")* Arg?
Index = Expr
Obj = (Prop ("," Prop)* ","?)?
Prop = "..." Assign | Key ":" Assign | x ("=" Assign)? | ("get" | "set" | "async" | "*")* Key TypeParams? params TypeAnn? block
Key = Name | s | n | index | "#" x
Classbody = Member*
Mod = "static" | "async" | "get" | "set" | "*" | TsMod
Member = ";" | "static" block | Decorator* Mod* Key ("?" | "!")? TypeParams? params TypeAnn? (block | TsEnd) | Decorator* Mod* Key ("?" | "!")? TypeAnn? ("=" Assign)? End
Switch = Case*
Case = ("case" Expr | "default") ":" Stmt*
"""

_JS_ONLY = """
TypeAnn = "never"
TypeParams = "never"
TypeArgs = "never"
Types = "never"
TsDecl = "never"
TsAs = "never"
TsBang = "never"
TsMod = "never"
TsEnd = "never"
"""

_TS_ONLY = """
TypeAnn = ":" (x "is")? Type | ":" "asserts" x ("is" Type)?
TypeParams = "<" TypeParam ("," TypeParam)* ","? ">"
TypeParam = ("const" | "in" | "out")? x ("extends" Type)? ("=" Type)?
TypeArgs = "<" Types ">"
Types = Type ("," Type)*
Type = Union ("extends" Union "?" Type ":" Type)?
Union = ("|" | "&")? TypeUn (("|" | "&") TypeUn)*
TypeUn = ("keyof" | "readonly" | "typeof" | "unique" | "infer")* TypePrim (dims | typeindex)*
TypePrim = x ("." x)* TypeArgs? | s | n | "-" n | "void" | objtype | tuple | parentype | "new"? TypeParams? params "=>" Type | "import" args ("." x)* TypeArgs?
Dims = "^"
Typeindex = Type
Tuple = (TupleItem ("," TupleItem)* ","?)?
TupleItem = "..."? (x "?"? ":")? Type "?"?
Parentype = Type
Objtype = (TypeMember (";" | "," | "^"))* 
TypeMember = ("readonly" | "+" | "-" | "static")* (Key | mapkey) ("+" | "-")? "?"? (":" Type)? | "new"? TypeParams? params TypeAnn? | ("get" | "set")? Key "?"? TypeParams? params TypeAnn?
Mapkey = x ("in" Type ("as" Type)? | ":" Type)
TsDecl = "declare"? TsDecl2
TsDecl2 = "interface" x TypeParams? ("extends" Types)? objtype | "type" x TypeParams? "=" Type End | "const"? "enum" x enumbody | ("namespace" | "module") (x ("." x)* | s) module | "global" module | "declare" (Var | Func2 | Class) | "abstract" Class | Func2 | "import" x "=" Expr End
Func2 = "async"? "function" x TypeParams? params TypeAnn? End
Enumbody = (Key ("=" Assign)? ("," Key ("=" Assign)?)* ","?)?
TsAs = ("as" | "satisfies") ("const" | Type)
TsBang = "!"
TsMod = "public" | "private" | "protected" | "readonly" | "abstract" | "override" | "declare" | "accessor"
TsEnd = End
"""

_GO = """
File = Pack Top*
Tops = Top*
Pack = "package" x End
End = ";" | "^"
Top = Import | Func | Decl | ";"
Import = "import" (ImportSpec | imports) End
ImportSpec = (x | ".")? s
Imports = (ImportSpec End)*
Func = "func" params? x TypeParams? params Result? block? End
TypeParams = index
Result = params | Type
Type = "*" Type | x ("." x)? index? | dims Type | index Type | "map" index Type | "<-"? "chan" "<-"? Type | "func" params Result? | "struct" fields | "interface" ibody | paren | "~" Type | Type "|" Type
Decl = ("var" | "const") (Spec | specs) End | "type" (TypeSpec | typespecs) End
Spec = Ids Type? ("=" Exprs)?
Specs = (Spec End)*
TypeSpec = x TypeParams? "="? Type
Typespecs = (TypeSpec End)*
Ids = x ("," x)*
Exprs = Expr ("," Expr)*
Simple = Exprs | Exprs (":=" | "=" | asg) "range"? Exprs | Expr inc | Expr "<-" Expr
Block = Stmt*
Stmt = Decl | Simple End | If | "for" ForHead? block End | "switch" SwHead? switch End | "select" switch End | ("defer" | "go") Expr End | "return" Exprs? End | ("break" | "continue" | "goto") x? End | "fallthrough" End | block End | x ":" | ";"
If = "if" (Simple? ";")? Expr block ("else" (If | block))? End
ForHead = Simple | Simple? ";" Expr? ";" Simple? | "range" Expr
SwHead = (Simple? ";")? Simple?
Switch = (("case" (Exprs | Types | Simple) | "default") ":" Stmt*)*
Types = Type ("," Type)*
Expr = Un (BinOp Un)*
BinOp = op | "+" | "-" | "*" | "/" | "&" | "|" | "<" | ">" | "<-"
Un = ("!" | "-" | "+" | "xor" | "*" | "&" | "<-")* Post
Post = Prim Tail*
Prim = x | n | s | paren | "func" params Result? block | LitType lit | LitType args
LitType = dims Type | index Type | "map" index Type | "struct" fields | "chan" Type | "interface" ibody | "func" params
Tail = "." x | "." typeassert | args | index | lit
Typeassert = Type | "type"
Paren = Expr | Type
Args = (Arg ("," Arg)* ","?)?
Arg = (Expr | Type) "..."?
Params = (Param ("," Param)* ","?)?
Param = x? "..."? Type | x
Index = Expr | Expr? ":" Expr? (":" Expr)? | Types ","? | "..." | (x ("," x)* Type) ("," x ("," x)* Type)*
Dims = "^"
Lit = (Elem ("," Elem)* ","?)?
Elem = (Expr | lit) (":" (Expr | lit))?
Fields = (Field End)*
Field = (x ("," x)* Type | "*"? x ("." x)? index?) s?
Ibody = ((x params Result? | Type) End)*
"""

_JAVA = """
File = (Annotation* "package" Name ";")? (Import | ";")* TypeDecl*
Import = "import" "static"? Name ("." "*")? ";"
Name = x ("." x)*
TypeDecl = Mods TypeDecl2 | ";"
TypeDecl2 = ("class" | "interface" | "record" | "@" "interface") x TypeParams? params? ("extends" Types)? ("implements" Types)? ("permits" Types)? classbody | "enum" x ("implements" Types)? enumbody
Mods = (Mod | Annotation)*
Mod = "public" | "private" | "protected" | "static" | "final" | "abstract" | "native" | "synchronized" | "transient" | "volatile" | "strictfp" | "default" | "sealed" | "non" "-" "sealed"
Annotation = "@" Name (args | annargs)?
Annargs = (x "=" Init ("," x "=" Init)* | Init)?
TypeParams = "<" TypeParam ("," TypeParam)* ">"
TypeParam = Annotation* x ("extends" Type ("&" Type)*)?
Types = Type ("," Type)*
Type = Annotation* (prim | x TypeArgs? ("." x TypeArgs?)*) dims*
TypeArgs = "<" (TypeArg ("," TypeArg)*)? ">"
TypeArg = Type | Annotation* "?" (("extends" | "super") Type)?
Dims = "^"
Classbody = Member*
Member = TypeDecl | "static"? block | Mods TypeParams? (Type | "void") x params dims* Throws? (block | ";" | "default" Init ";") | Mods TypeParams? x params? Throws? block | Mods Type Bind ("," Bind)* ";"
Throws = "throws" Types
Bind = x dims* ("=" Init)?
Init = Expr | init
Inits = (Init ("," Init)* ","?)?
Enumbody = (EnumConst ("," EnumConst)*)? ","? (";" Member*)?
EnumConst = Annotation* x args? classbody?
Block = Stmt*
Local = Mods Type Bind ("," Bind)*
Stmt = Local ";" | Expr ";" | ";" | block | "if" paren Stmt ("else" Stmt)? | "for" forhead Stmt | "while" paren Stmt | "do" Stmt "while" paren ";" | Try | "switch" paren switch | "return" Expr? ";" | "throw" Expr ";" | ("break" | "continue") x? ";" | "yield" Expr ";" | "synchronized" paren block | "assert" Expr (":" Expr)? ";" | x ":" Stmt | Mods TypeDecl2
Try = "try" resources? block ("catch" params block)* ("finally" block)?
Resources = Res (";" Res)* ";"?
Res = Local | Expr
Forhead = (Local | Exprs)? ";" Expr? ";" Exprs? | Mods Type x ":" Expr
Exprs = Expr ("," Expr)*
Switch = (CaseHead (":" Stmt* | "->" (Expr ";" | block | "throw" Expr ";")))*
CaseHead = "case" CaseItem ("," CaseItem)* ("when" Expr)? | "default"
CaseItem = Cond | Type x | Type params | "default"
Expr = Lambda | Cond (("=" | asg) Expr)?
Lambda = (x | params | args) "->" (Expr | block)
Cond = Bin ("?" Expr ":" Expr)?
Bin = Un (BinOp Un | "instanceof" Mods Type (x | params)?)*
BinOp = op | "+" | "-" | "*" | "/" | "&" | "|" | "<" | ">" ">"? ">"? "="?
Un = ("!" | "~" | "+" | "-" | inc | cast)* (Post | Lambda)
Post = Prim Tail* inc?
Tail = "." x | "." TypeArgs x | "." "class" | "." "new" Creator | "." ("this" | "super") | args | index | "::" TypeArgs? (x | "new")
Prim = x | n | s | c | paren | "this" | "super" | "new" Creator | "switch" paren switch | (prim | x) dims* "." "class" | "void" "." "class" | (prim | x TypeArgs?) dims* "::" (x | "new")
Creator = Annotation* (prim | x TypeArgs? ("." x TypeArgs?)*) (args classbody? | (index | dims)+ init?)
Paren = Expr
Cast = Type ("&" Type)*
Args = (Expr ("," Expr)*)?
Params = (Param ("," Param)*)? | x ("," x)*
Param = Mods Type ("|" Type)* "..."? (x | "this") dims*
Index = Expr
"""
_JAVA = _JAVA.replace("\nInits =", "\nInit2 =")

_RUST = """
File = Item*
Attr = "#" "!"? any
Vis = "pub" any?
Item = Attr* Vis? Item2 | Attr
Item2 = Fn | "struct" x Gen? (Where? fields | any Where? ";" | Where? ";") | "union" x Gen? fields | "enum" x Gen? Where? enumbody | "unsafe"? "impl" Gen? "!"? Type ("for" Type)? Where? items | "unsafe"? "trait" x Gen? (":" Bounds?)? Where? items | "use" UseTree ";" | "mod" x (";" | items) | ("const" | "static") "mut"? x ":" Type ("=" Expr)? ";" | "type" x Gen? (":" Bounds)? Where? ("=" Type)? Where? ";" | "extern" s? items | "extern" "crate" x ("as" x)? ";" | Macro ";"? 
Macro = Path "!" x? any
UseTree = "::"? UseSeg ("::" UseSeg)* ("as" x)?
UseSeg = x | "*" | any
Fn = ("const" | "async" | "unsafe" | "extern" s?)* "fn" x Gen? params ("->" Type)? Where? (block | ";")
Gen = "<" (GenParam ("," GenParam)* ","?)? ">"
GenParam = life (":" life ("+" life)*)? | "const" x ":" Type ("=" n)? | x (":" Bounds?)? ("=" Type)?
Where = "where" (WhereItem ("," WhereItem)* ","?)?
WhereItem = (Type | life) ":" Bounds
Bounds = Bound ("+" Bound)*
Bound = life | "?"? ("for" Gen)? Path | any
Type = "&" life? "mut"? Type | "*" ("const" | "mut") Type | Path | any | ("dyn" | "impl") Bounds | ("for" Gen)? "unsafe"? ("extern" s?)? "fn" any ("->" Type)? | "!" | "<" Type ("as" Type)? ">" "::" Path
Path = "::"? Seg ("::" Seg)*
Seg = x (GenArgs | any "->" Type)? | "::"? GenArgs
GenArgs = "<" (GenArg ("," GenArg)* ","?)? ">"
GenArg = Type | life | n | s | x "=" Type | x ":" Bounds
Fields = (Field ("," Field)* ","?)?
Field = Attr* Vis? x ":" Type
Enumbody = (Variant ("," Variant)* ","?)?
Variant = Attr* x (any | fields)? ("=" Expr)?
Items = Item*
Params = (Param ("," Param)* ","?)?
Param = Attr* (("&" life?)? "mut"? x | Pat ":" Type | "...")
Block = (Attr? Stmt)* Expr?
Stmts = (Attr? Stmt)*
Stmt = "let" Pat (":" Type)? ("=" Expr ("else" block)?)? ";" | Item | BlockExpr ";"? | Expr ";" | ";"
BlockExpr = (life ":")? (If | "match" Expr match | "while" Cond block | "for" Pat "in" Expr block | "loop" block | "unsafe" block | "async" "move"? block | block)
If = "if" Cond block ("else" (If | block))?
Cond = Let | Expr
Let = "let" Pat "=" Expr
Expr = Range (("=" | asg) Expr)?
Range = Bin? (".." | "..=") Bin? | Bin
Bin = Un (BinOp (Un | Let))*
BinOp = op | "+" | "-" | "*" | "/" | "&" | "|" | "<" | ">" ">"? "="?
Un = ("!" | "-" | "*" | "&" "mut"? | "&" "&")* Post ("as" Type)* | Closure | ("return" | "break" life? | "yield") Expr? | "continue" life? | Let
Closure = "move"? ("|" (ClosureParam ("," ClosureParam)* ","?)? "|" | "||") ("->" Type)? Expr
ClosureParam = Pat1 (":" Type)?
Post = Prim Tail*
Tail = "." (x | n) ("::" GenArgs)? | args | index | "?"
Prim = Path | Path struct | n | s | c | args | arr | BlockExpr | Macro
Args = (Expr ("," Expr)* ","?)?
Index = Expr
Arr = (Expr (("," Expr)* ","? | ";" Expr))?
Struct = (StructItem ("," StructItem)* ","?)? (".." Expr)?
StructItem = Attr* (x | n) (":" Expr)?
Match = (Arm)* LastArm?
Arm = Attr* Pat ("if" Expr)? "=>" (Expr "," | BlockExpr ","?)
LastArm = Attr* Pat ("if" Expr)? "=>" Expr
Pat = "|"? Pat1 ("|" Pat1)*
Pat1 = "&"* ("ref" | "mut")* (x "@" Pat1 | Path any? | "-"? n | s | c | any | ".." | Macro) ((".." | "..=") ("-"? n | c | Path)?)?
"""

_C = """
File = Ext*
Ext = Func | Decl | ";" | x args ";"?
Func = Specs Ptr x params Attr* Decl* block
Attr = x args
Specs = Spec+
Spec = type | qual | x | ("struct" | "union") (x fields? | fields) | "enum" (x enumbody? | enumbody) | "typeof" paren
Fields = (Specs (Declr (":" Expr)? ("," Declr (":" Expr)?)*)? ";" | Specs ":" Expr ";")*
Enumbody = (x ("=" Assign)? ("," x ("=" Assign)?)* ","?)?
Ptr = ("*" qual*)*
Decl = Specs (InitDeclr ("," InitDeclr)*)? Attr* ";"
InitDeclr = Declr ("=" Init)?
Init = Assign | init
Initlist = (InitItem ("," InitItem)* ","?)?
InitItem = (("." x | index)+ "=")? Init
Declr = Ptr (x | declparen) (dims | index | params)*
Declparen = Declr | "^"
Dims = "^" | "static"? qual* Assign
Params = (Param ("," Param)*)? 
Param = Specs (Declr | Abstract)? | "..."
Abstract = Ptr declparen? (dims | index | params)*
Block = Stmt*
Stmt = Decl | Expr? ";" | block | "if" paren Stmt ("else" Stmt)? | "for" forhead Stmt | "while" paren Stmt | "do" Stmt "while" paren ";" | "switch" paren Stmt | "case" Expr ("..." Expr)? ":" Stmt? | "default" ":" Stmt? | "return" (Expr | init)? ";" | "break" ";" | "continue" ";" | "goto" x ";" | x ":" Stmt?
Forhead = (Specs InitDeclr ("," InitDeclr)* | Expr)? ";" Expr? ";" Expr?
Expr = Assign ("," Assign)*
Assign = Cond (("=" | asg) Assign)?
Cond = Bin ("?" Expr? ":" Cond)?
Bin = Un (BinOp Un)*
BinOp = op | "+" | "-" | "*" | "/" | "&" | "|" | "<" | ">" ">"? "="?
Un = ("!" | "~" | "+" | "-" | "*" | "&" | inc | typename | "sizeof")* Post | "sizeof" typename
Post = (Prim | typename init) Tail* inc?
Tail = "." x | "->" x | args | index
Prim = x | n | s+ | c | paren
Paren = Expr | gnublock
Typename = Specs Abstract?
Args = ((Assign | Typename) ("," (Assign | Typename))*)?
Index = Expr
"""

_PYTHON = """
Python38 = Stmt*
Python310 = Stmt310*
Python312 = Stmt312*
Suite = Stmt*
Suite310 = Stmt310*
Suite312 = Stmt312*
Cases = Case+
Stmt = Simple | Compound
Stmt310 = Stmt | Match
Stmt312 = Stmt310 | "type" x index? "=" Expr End | "async"? "def" x index params ("->" Expr)? ":" Body | "class" x index args? ":" Body
End = "^"
Body = suite | suite310 | suite312 | Simple
Match = "match" Exprs ":" cases
Case = "case" Pattern ("if" Named)? ":" Body
Pattern = PatAs ("," PatAs)* ","?
PatAs = "*"? PatPrim ("|" PatPrim)* ("as" x)?
PatPrim = "-"? n (("+" | "-") n)? | s+ | x ("." x)* patargs? | paren | patargs | list | dict
Patargs = (PatArg ("," PatArg)* ","?)?
PatArg = (x "=")? PatAs
Simple = Small (";" Small)* ";"? End
Small = Assignment | "return" Exprs? | "raise" (Expr ("from" Expr)?)? | "pass" | "break" | "continue" | "del" Exprs | "assert" Expr ("," Expr)? | ("global" | "nonlocal") x ("," x)* | "import" Dotted ("," Dotted)* | "from" ("." | "...")* (x ("." x)*)? "import" ("*" | Names | names)
Dotted = x ("." x)* ("as" x)?
Names = x ("as" x)? ("," x ("as" x)?)* ","?
Assignment = Exprs | (Targets "=")+ (Exprs | Yield) | Place asg (Exprs | Yield) | Place ":" Expr ("=" (Exprs | Yield))? | Yield
Place = x | paren | list | Atom ("." x | args | index)* ("." x | index)
Yield = "yield" ("from" Expr | Exprs)?
Exprs = Item ("," Item)* ","?
Item = "*"? Named
Named = (x ":=")? Expr
Compound = "if" Named ":" Body ("elif" Named ":" Body)* ("else" ":" Body)? | "while" Named ":" Body ("else" ":" Body)? | "async"? "for" Targets "in" Exprs ":" Body ("else" ":" Body)? | Try | "async"? "with" (WithItem ("," WithItem)* | withitems) ":" Body | Def
Targets = "*"? Place ("," "*"? Place)* ","?
WithItem = Expr ("as" Place)?
Withitems = WithItem ("," WithItem)* ","?
Try = "try" ":" Body ((("except" "*"? (Exprs ("as" x)?)? ":" Body)+ ("else" ":" Body)? ("finally" ":" Body)?) | "finally" ":" Body)
Def = ("@" Named End)* ("async"? "def" x params ("->" Expr)? ":" Body | "class" x args? ":" Body)
Expr = Lambda | Or ("if" Or "else" Expr)?
Lambda = "lambda" LamParams? ":" Expr
LamParams = LamParam ("," LamParam)* ","?
LamParam = ("*" | "**")? x ("=" Expr)? | "*" | "/"
Or = Not (BinOp Not)*
BinOp = op | "+" | "-" | "*" | "**" | "/" | "&" | "|" | "<" | ">" | "@" | "and" | "or" | "not"? "in" | "is" "not"?
Not = ("not" | "-" | "+" | "~" | "await")* (Primary | Lambda)
Primary = Atom ("." x | args | index)*
Atom = x | n | s+ | paren | list | dict | "..."
Paren = (Item ("," Item)* ","?)? | Item Comp | Yield
Args = (ArgList ","?)? | Named Comp
ArgList = Plain ("," Plain)* ("," Named1 ("," Named1)*)? ("," Named2 ("," Named2)*)? | Named1 ("," Named1)* ("," Named2 ("," Named2)*)? | Named2 ("," Named2)*
Plain = "*"? Named
Named1 = x "=" Expr | "*" Named
Named2 = x "=" Expr | "**" Expr
Params = (Param ("," Param)* ","?)?
Param = ("*" | "**")? x (":" "*"? Expr)? ("=" Expr)? | "*" | "/"
List = (Item ("," Item)* ","?)? | Item Comp
Comp = ("async"? "for" Targets "in" Or ("if" OrNamed)*)+
OrNamed = (x ":=")? Or ("if" Or "else" Expr)? | Lambda
Index = Slice ("," Slice)* ","?
Slice = "*"? Named | Expr? ":" Expr? (":" Expr?)?
Dict = (Entry ("," Entry)* ","?)? | Expr ":" Expr Comp | Item Comp
Entry = "**" Or | Expr ":" Expr | Item
"""

#: language: grammar text; rules for round, square and curly brackets; start rules (dialects) of a file.
GRAMMARS = {
    "javascript": (_JS_COMMON + _JS_ONLY, ("Paren", "Args", "Params", "Forhead"), ("Arr", "Index"), ("Block", "Obj", "Classbody", "Switch", "Names"), ("Module", "Script")),
    "typescript": (
        _JS_COMMON + _TS_ONLY,
        ("Paren", "Args", "Params", "Forhead", "Parentype"),
        ("Arr", "Index", "Dims", "Tuple", "Typeindex", "Mapkey"),
        ("Block", "Obj", "Classbody", "Switch", "Names", "Objtype", "Enumbody", "Module"),
        ("Module", "Script"),
    ),
    "go": (_GO, ("Args", "Params", "Paren", "Imports", "Specs", "Typespecs", "Typeassert"), ("Dims", "Index"), ("Block", "Lit", "Switch", "Fields", "Ibody"), ("File",)),
    "java": (_JAVA, ("Paren", "Args", "Params", "Forhead", "Resources", "Cast", "Annargs"), ("Dims", "Index"), ("Block", "Classbody", "Switch", "Init2", "Enumbody"), ("File",)),
    "rust": (_RUST, ("Args", "Params"), ("Index", "Arr"), ("Block", "Items", "Fields", "Enumbody", "Struct", "Match"), ("File",)),
    "c": (_C, ("Paren", "Args", "Params", "Forhead", "Declparen", "Typename"), ("Dims", "Index"), ("Block", "Fields", "Initlist", "Enumbody"), ("File",)),
    "python": (_PYTHON, ("Paren", "Args", "Params", "Names", "Withitems", "Patargs"), ("List", "Index"), ("Dict",), ("Python38", "Python310", "Python312")),
}
#: names of groups that the grammars ask for under another name
ALIASES = {"init2": "init", "initlist": "init", "module": "module"}
