"""Grammars of the supported languages, in the notation of ``gll``. Dialects of a language are start rules of one grammar."""

JSON = """
File = Value ;
Value = '{' (Pair (',' Pair)*)? '}' | '[' (Value (',' Value)*)? ']' | STRING | NUMBER | WORD ;
Pair = STRING ':' Value ;
"""

TOML = """
File = Line (NEWLINE Line)* ;
Line = (Pair | 'TABLE[' Key 'TABLE]' | '[[' Key ']]')? ;
Pair = Key '=' Value ;
Key = KEY ('.' KEY)* ;
Value = VALUE | '[' (Value (',' Value)* ','?)? ']' | '{' (Pair (',' Pair)*)? '}' ;
"""

PYTHON = """
File = (NEWLINE | Statement)* ;
Statement = Compound | Simple ;
Simple = Small (';' Small)* ';'? NEWLINE ;
Block = NEWLINE INDENT Statement+ DEDENT | Simple ;
Small = Assignment | StarExpressions | 'pass' | 'break' | 'continue' | 'return' StarExpressions? | 'raise' (Expression ('from' Expression)?)?
  | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)* | 'del' DelTarget (',' DelTarget)* ','? | 'assert' Expression (',' Expression)?
  | 'import' DottedAs (',' DottedAs)* | 'from' FromWhere 'import' FromNames | 'type' NAME TypeParams? '=' Expression ;
DottedAs = Dotted ('as' NAME)? ;
Dotted = NAME ('.' NAME)* ;
FromWhere = ('.' | '...')* Dotted | ('.' | '...')+ ;
FromNames = '*' | NameAs (',' NameAs)* | '(' NameAs (',' NameAs)* ','? ')' ;
NameAs = NAME ('as' NAME)? ;
Assignment = (StarTargets '=')+ (Yield | StarExpressions) | SingleTarget Augmented (Yield | StarExpressions)
  | (SingleTarget | '(' SingleTarget ')') ':' Expression ('=' (Yield | StarExpressions))? ;
Augmented = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
SingleTarget = NAME | Primary '.' NAME | Primary '[' Slices ']' | '(' SingleTarget ')' ;
StarTargets = StarTarget (',' StarTarget)* ','? ;
StarTarget = '*'? Target ;
Target = NAME | Primary '.' NAME | Primary '[' Slices ']' | '(' StarTargets? ')' | '[' StarTargets? ']' ;
DelTarget = NAME | Primary '.' NAME | Primary '[' Slices ']' | '(' (DelTarget (',' DelTarget)* ','?)? ')' | '[' (DelTarget (',' DelTarget)* ','?)? ']' ;
Compound = 'if' Named ':' Block ('elif' Named ':' Block)* Else? | 'while' Named ':' Block Else?
  | 'async'? 'for' StarTargets 'in' StarExpressions ':' Block Else?
  | 'try' ':' Block (Except+ Else? Finally? | ExceptStar+ Else? Finally? | Finally)
  | 'async'? 'with' (WithItem (',' WithItem)* | '(' WithItem (',' WithItem)* ','? ')') ':' Block
  | Decorator* 'async'? 'def' NAME TypeParams? '(' Parameters ')' ('->' Expression)? ':' Block
  | Decorator* 'class' NAME TypeParams? ('(' Arguments ')')? ':' Block
  | 'match' Subject ':' NEWLINE INDENT Case+ DEDENT ;
Else = 'else' ':' Block ;
Finally = 'finally' ':' Block ;
Except = 'except' (Expression ('as' NAME)? )? ':' Block ;
ExceptStar = 'except' '*' Expression ('as' NAME)? ':' Block ;
WithItem = Expression ('as' StarTarget)? ;
Decorator = '@' Named NEWLINE ;
TypeParams = '[' TypeParam (',' TypeParam)* ','? ']' ;
TypeParam = NAME (':' Expression)? ('=' Expression)? | '*' NAME | '**' NAME ;
Parameters = ParamList? ;
ParamList = Param (',' Param)* (',' '/' (',' Param)*)? (',' StarParams)? ','? | StarParams ','? ;
StarParams = '*' (NAME (':' StarExpression)?)? (',' Param)* (',' '**' NAME Annotation?)? | '**' NAME Annotation? ;
Param = NAME Annotation? ('=' Expression)? ;
Annotation = ':' Expression ;
Subject = Named | StarExpression ',' (StarExpression (',' StarExpression)* ','?)? ;
Case = 'case' Patterns ('if' Named)? ':' Block ;
Patterns = Pattern | StarPattern ',' (StarPattern (',' StarPattern)* ','?)? ;
StarPattern = '*' NAME | Pattern ;
Pattern = ClosedPattern ('|' ClosedPattern)* ('as' NAME)? ;
ClosedPattern = '-'? NUMBER (('+' | '-') NUMBER)? | STRING+ | 'None' | 'True' | 'False' | Dotted ('(' (ArgPattern (',' ArgPattern)* ','?)? ')')?
  | '(' Patterns? ')' | '[' Patterns? ']' | '{' (KeyPattern (',' KeyPattern)* ','?)? '}' ;
ArgPattern = Pattern | NAME '=' Pattern ;
KeyPattern = ('-'? NUMBER | STRING+ | Dotted | 'None' | 'True' | 'False') ':' Pattern | '**' NAME ;
StarExpressions = StarExpression (',' StarExpression)* ','? | Yield ;
StarExpression = Expression | '*' BitOr ;
Named = NAME ':=' Expression | Expression ;
Yield = 'yield' ('from' Expression | StarExpressions)? ;
Expression = Or ('if' Or 'else' Expression)? | 'lambda' LambdaParams ':' Expression ;
LambdaParams = (LambdaParam (',' LambdaParam)* (',' '/' (',' LambdaParam)*)? (',' LambdaStar)? ','? | LambdaStar ','?)? ;
LambdaStar = '*' NAME? (',' LambdaParam)* (',' '**' NAME)? | '**' NAME ;
LambdaParam = NAME ('=' Expression)? ;
Or = And ('or' And)* ;
And = Not ('and' Not)* ;
Not = 'not' Not | Comparison ;
Comparison = BitOr (Compare BitOr)* ;
Compare = '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' 'not'? ;
BitOr = Factor (Binary Factor)* ;
Binary = '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' ;
Factor = ('+' | '-' | '~') Factor | 'await'? Primary ('**' Factor)? ;
Primary = Atom | Primary '.' NAME | Primary '(' Arguments ')' | Primary '[' Slices ']' ;
Arguments = (Argument (',' Argument)* ','? | Named Comprehension)? ;
Argument = Named | NAME '=' Expression | '*' Expression | '**' Expression ;
Slices = Slice (',' Slice)* ','? ;
Slice = Named | '*' BitOr | Expression? ':' Expression? (':' Expression?)? ;
Comprehension = ('async'? 'for' StarTargets 'in' Or ('if' CompIf)*)+ ;
CompIf = Named ;
Atom = NAME | NUMBER | STRING+ | '...' | 'None' | 'True' | 'False' | '(' ')' | '(' (Yield | NamedStar (',' NamedStar)* ','? | Named Comprehension) ')'
  | '[' (NamedStar (',' NamedStar)* ','? | Named Comprehension)? ']' | '{' '}'
  | '{' (NamedStar (',' NamedStar)* ','? | Named Comprehension | Entry (',' Entry)* ','? | Expression ':' Expression Comprehension) '}' ;
NamedStar = Named | '*' BitOr ;
Entry = Expression ':' Expression | '**' BitOr ;
"""

SCRIPT = """
Module = Item* ;
Item = Import | Export | Statement | Declaration ;
Semi = ';' | @end ;
Name = NAME ;
AnyName = NAME | KEYWORD ;
Import = 'import' STRING With? Semi | 'import' Clause 'from' STRING With? Semi ;
With = 'with' '{' (WithPair (',' WithPair)* ','?)? '}' ;
WithPair = (AnyName | STRING) ':' STRING ;
Clause = Name (',' (Everything | Named))? | Everything | Named ;
Everything = '*' 'as' Name ;
Named = '{' (Specifier (',' Specifier)* ','?)? '}' ;
Specifier = Name | (AnyName | STRING) 'as' Name ;
Export = 'export' '*' ('as' (AnyName | STRING))? 'from' STRING With? Semi | 'export' ExportNames ('from' STRING With?)? Semi
  | 'export' Declaration | 'export' Variable | 'export' 'default' (Function | Class | Assign Semi) ;
ExportNames = '{' (ExportName (',' ExportName)* ','?)? '}' ;
ExportName = (AnyName | STRING) ('as' (AnyName | STRING))? ;
Declaration = Function | Class | Lexical ;
Lexical = ('const' | 'let') Bind (',' Bind)* Semi ;
Variable = 'var' Bind (',' Bind)* Semi ;
Bind = Binding Init? ;
Init = '=' Assign ;
Binding = Name | ObjectBinding | ArrayBinding ;
ObjectBinding = '{' (BindProperty (',' BindProperty)* ','?)? '}' ;
BindProperty = Name Init? | PropertyName ':' Binding Init? | '...' Binding ;
ArrayBinding = '[' ','* (BindElement (','+ BindElement)* ','*)? ']' ;
BindElement = Binding Init? | '...' Binding ;
Function = 'async'? 'function' '*'? Name? Signature Body ;
Signature = '(' Parameters ')' ;
Parameters = (Parameter (',' Parameter)* ','?)? ;
Parameter = Binding Init? | '...' Binding ;
Body = '{' StatementItem* '}' ;
StatementItem = Statement | Declaration ;
Class = Decorator* 'class' Name? Heritage '{' Member* '}' ;
Decorator = '@' LeftSide ;
Heritage = ('extends' LeftSide)? ;
Member = ';' | Decorator* 'static'? MemberRest | 'static' Body ;
MemberRest = Modifier* PropertyName Signature Body | Accessor PropertyName Signature Body | 'accessor'? PropertyName Init? Semi ;
Modifier = 'async' @same | '*' ;
Accessor = 'get' | 'set' ;
PropertyName = AnyName | STRING | NUMBER | PRIVATE | '[' Assign ']' ;
Statement = Body | Variable | ';' | Expression Semi | 'if' '(' Expression ')' Statement ('else' Statement | @noelse) | 'do' Statement 'while' '(' Expression ')' ';'?
  | 'while' '(' Expression ')' Statement | 'for' '(' ForHead ')' Statement | 'for' 'await' '(' ForBind 'of' Assign ')' Statement
  | 'continue' (@same Name)? Semi | 'break' (@same Name)? Semi | 'return' (@same Expression)? Semi | 'throw' @same Expression Semi
  | 'switch' '(' Expression ')' '{' SwitchCase* '}' | Name ':' Statement | 'debugger' Semi
  | 'try' Body ('catch' ('(' CatchBinding ')')? Body ('finally' Body)? | 'finally' Body) ;
CatchBinding = Binding ;
SwitchCase = ('case' Expression | 'default') ':' StatementItem* ;
ForHead = ForInit? ';' Expression? ';' Expression? | ForBind 'of' Assign | ForBind 'in' Expression ;
ForInit = Expression | ('var' | 'let' | 'const') Bind (',' Bind)* ;
ForBind = ('var' | 'let' | 'const') Binding | LeftSide ;
Expression = Assign (',' Assign)* ;
Assign = Conditional | Arrow | LeftSide AssignOp Assign | Pattern '=' Assign | 'yield' (@same '*'? Assign)? ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | '>' @glued '>' @glued '=' | '>' @glued '>' @glued '>' @glued '=' ;
Pattern = '{' (PatternProperty (',' PatternProperty)* ','?)? '}' | '[' ','* (PatternElement (','+ PatternElement)* ','*)? ']' ;
PatternProperty = Name Init? | PropertyName ':' PatternTarget Init? | '...' PatternTarget ;
PatternElement = PatternTarget Init? | '...' PatternTarget ;
PatternTarget = LeftSide | Pattern ;
Arrow = 'async'? ArrowHead @same '=>' ArrowBody ;
ArrowHead = Name | Signature ;
ArrowBody = Body | Assign ;
Conditional = Binary ('?' Assign ':' Assign)? ;
Binary = Unary (BinaryOp Unary)* | PRIVATE 'in' Binary ;
BinaryOp = '||' | '&&' | '??' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>' @glued '=' | 'instanceof' | 'in'
  | '<<' | '>' @glued '>' | '>' @glued '>' @glued '>' | '+' | '-' | '*' | '/' | '%' | '**' ;
Unary = ('delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | 'await') Unary | ('++' | '--') Unary | LeftSide (@same ('++' | '--'))? ;
LeftSide = Primary | 'new' NewTarget | LeftSide Suffix | 'super' SuperSuffix | 'import' ('(' Assign (',' Assign)? ','? ')' | '.' AnyName) ;
SuperSuffix = '.' AnyName | '[' Expression ']' | Args ;
NewTarget = '.' AnyName | LeftSide ;
Suffix = '.' (AnyName | PRIVATE) | '?.' (AnyName | PRIVATE | '[' Expression ']' | Args | Template) | '[' Expression ']' | Args | Template ;
Args = '(' (Argument (',' Argument)* ','?)? ')' ;
Argument = '...'? Assign ;
Primary = 'this' | Name | 'null' | 'true' | 'false' | NUMBER | STRING | REGEX | Template | Function | Class | '(' Expression ')' | ArrayLiteral | ObjectLiteral ;
ArrayLiteral = '[' ','* (Argument (','+ Argument)* ','*)? ']' ;
ObjectLiteral = '{' (Property (',' Property)* ','?)? '}' ;
Property = Name | PropertyName ':' Assign | '...' Assign | Modifier* PropertyName Signature Body | Accessor PropertyName Signature Body ;
Template = TEMPLATE ('${' Expression '}$')* TEMPLATE_END ;
"""

# What TypeScript adds; a rule that is named again gets further alternatives.
TYPED = SCRIPT + """
Ambients = AmbientItem* ;
AmbientItem = Import | Export | Declaration ;
Typed = ':' Type ;
Import = 'import' 'type' Clause 'from' STRING With? Semi | 'import' 'type'? Name '=' (('require' '(' STRING ')') | Qualified) Semi ;
Specifier = 'type' Name | 'type' AnyName 'as' Name ;
Export = 'export' 'type' (ExportNames | '*' ('as' Name)?) ('from' STRING)? Semi | 'export' '=' Expression Semi | 'export' 'as' 'namespace' Name Semi | 'export' 'import' Name '=' Qualified Semi | 'export' 'default' (Interface | 'abstract' Class) ;
ExportName = 'type' AnyName ('as' AnyName)? ;
Declaration = Interface | Alias | Enum | Namespace | Ambient | 'abstract' Class | Overload ;
Overload = 'async'? 'function' '*'? Name Signature Semi ;
Ambient = 'declare' (Declaration | Variable | 'global' NamespaceBody) ;
Interface = 'interface' @same Name TypeParams? ('extends' TypeRef (',' TypeRef)*)? ObjectType ;
Alias = 'type' @same Name TypeParams? '=' Type Semi ;
Enum = 'const'? 'enum' Name '{' (EnumMember (',' EnumMember)* ','?)? '}' ;
EnumMember = (AnyName | STRING) Init? ;
Namespace = ('namespace' | 'module') @same (Qualified | STRING) (NamespaceBody | Semi) ;
NamespaceBody = '{' Item* '}' ;
Qualified = Name ('.' AnyName)* ;
Bind = Binding '!'? Typed Init? ;
Signature = TypeParams? '(' Parameters ')' (':' ReturnType)? ;
Parameter = Decorator* Access* ('this' | Binding) '?'? Typed? Init? | '...' Binding Typed ;
Access = 'public' | 'private' | 'protected' | 'readonly' | 'override' ;
Class = Decorator* 'class' Name? TypeParams Heritage '{' Member* '}' ;
Heritage = ('extends' LeftSide TypeArgs?)? 'implements' TypeRef (',' TypeRef)* | 'extends' LeftSide TypeArgs ;
Member = Decorator* MemberMark* MemberBody | MemberMark* IndexSignature Semi ;
MemberMark = 'public' | 'private' | 'protected' | 'readonly' | 'static' | 'abstract' | 'override' | 'declare' | 'accessor' ;
MemberBody = (Modifier* | Accessor) PropertyName '?'? Signature (Body | Semi) | PropertyName ('?' | '!')? Typed? Init? Semi ;
IndexSignature = '[' Name ':' Type ']' Typed ;
CatchBinding = Binding Typed ;
TypeParams = '<' TypeParam (',' TypeParam)* ','? '>' ;
TypeParam = ('const' | 'in' | 'out')* Name ('extends' Type)? ('=' Type)? ;
TypeArgs = '<' Type (',' Type)* ','? '>' ;
ReturnType = Type | 'asserts'? (Name | 'this') 'is' Type | 'asserts' (Name | 'this') ;
Type = Union ('extends' Union '?' Type ':' Type)? | FunctionType ;
FunctionType = 'abstract'? 'new'? TypeParams? '(' Parameters ')' '=>' ReturnType ;
Union = ('|' | '&')? UnaryType (('|' | '&') UnaryType)* ;
UnaryType = ('keyof' | 'unique' | 'readonly') UnaryType | 'infer' Name ('extends' Union)? | PostfixType ;
PostfixType = PrimaryType | PostfixType @same '[' Type? ']' ;
PrimaryType = TypeRef | 'void' | 'null' | 'this' | 'true' | 'false' | '-'? NUMBER | STRING | TemplateType | ObjectType | '(' Type ')' | TupleType
  | 'typeof' (Qualified | 'import' '(' STRING ')' ('.' AnyName)* | 'this' ('.' AnyName)*) TypeArgs? | 'import' '(' STRING ')' ('.' AnyName)* TypeArgs? ;
TypeRef = Qualified TypeArgs? ;
TemplateType = TEMPLATE ('${' Type '}$')* TEMPLATE_END ;
TupleType = '[' (TupleElement (',' TupleElement)* ','?)? ']' ;
TupleElement = '...'? Type '?'? | '...'? AnyName '?'? ':' Type ;
ObjectType = '{' TypeMembers? '}' | '{' MappedMark? '[' Name 'in' Type ('as' Type)? ']' MappedOptional? Typed? (';' | ',')? '}' ;
MappedMark = ('+' | '-')? 'readonly' ;
MappedOptional = ('+' | '-')? '?' ;
TypeMembers = TypeMember (TypeEnd TypeMember)* TypeEnd? ;
TypeEnd = ';' | ',' | @end ;
TypeMember = 'readonly'? (PropertyName '?'? Typed? | IndexSignature) | ('get' | 'set')? PropertyName '?'? Signature | 'new'? Signature ;
Arrow = 'async'? TypeParams '(' Parameters ')' (':' ReturnType)? @same '=>' ArrowBody ;
Binary = Binary ('as' ('const' | Type) | 'satisfies' Type) (BinaryOp Unary)* ;
Unary = '<' ('const' | Type) '>' Unary ;
LeftSide = LeftSide @same '!' ;
Suffix = TypeArgs Args | TypeArgs Template | '?.' TypeArgs Args ;
NewTarget = LeftSide TypeArgs ;
PatternTarget = LeftSide 'as' Type ;
"""

GO = """
File = 'package' NAME ';' (ImportDecl ';')* (TopDecl ';')* ;
ImportDecl = 'import' (ImportSpec | '(' (ImportSpec (';' ImportSpec)* ';'?)? ')') ;
ImportSpec = (NAME | '.')? STRING ;
TopDecl = Decl | FuncDecl ;
Decl = 'const' (ConstSpec | '(' (ConstSpec (';' ConstSpec)* ';'?)? ')') | 'var' (VarSpec | '(' (VarSpec (';' VarSpec)* ';'?)? ')') | 'type' (TypeSpec | '(' (TypeSpec (';' TypeSpec)* ';'?)? ')') ;
ConstSpec = Names (Type? '=' Exprs)? ;
VarSpec = Names (Type ('=' Exprs)? | '=' Exprs) ;
TypeSpec = NAME TypeParams? '='? Type ;
TypeParams = '[' TypeParam (',' TypeParam)* ','? ']' ;
TypeParam = Names Constraint ;
Constraint = Term ('|' Term)* ;
Term = '~'? Type ;
Names = NAME (',' NAME)* ;
FuncDecl = 'func' Receiver? NAME TypeParams? Signature Block? ;
Receiver = Params ;
Signature = Params (Params | Type)? ;
Params = '(' (Param (',' Param)* ','?)? ')' ;
Param = '...'? Type | NAME '...'? Type ;
Type = TypeName | '(' Type ')' | '[' ']' Type | '[' (Expr | '...') ']' Type | '*' Type | 'func' Signature | 'map' '[' Type ']' Type
  | 'chan' '<-'? Type | '<-' 'chan' Type | 'struct' '{' (Field (';' Field)* ';'?)? '}' | 'interface' '{' (Element (';' Element)* ';'?)? '}' ;
TypeName = NAME ('.' NAME)? TypeArgs? ;
TypeArgs = '[' Type (',' Type)* ','? ']' ;
Field = (Names Type | '*'? TypeName) STRING? ;
Element = NAME Signature | Constraint ;
Block = '{' Statements '}' ;
Statements = Statement? (';' Statement?)* ;
Statement = Decl | NAME ':' Statement? | SimpleStmt | 'go' Expr | 'defer' Expr | 'return' Exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | Block | If
  | 'switch' (SimpleStmt? ';')? Expr? '{' SwitchCase* '}' | 'switch' (SimpleStmt? ';')? (NAME ':=')? Primary '.' '(' 'type' ')' '{' TypeCase* '}'
  | 'switch' (SimpleStmt? ';')? '{' SwitchCase* '}' | 'select' '{' CommCase* '}' | 'for' ForHead? Block ;
If = 'if' (SimpleStmt? ';')? Expr Block ('else' (If | Block))? ;
ForHead = Expr | SimpleStmt? ';' Expr? ';' SimpleStmt? | (Exprs ('=' | ':='))? 'range' Expr ;
SwitchCase = ('case' Exprs | 'default') ':' Statements ;
TypeCase = ('case' Type (',' Type)* | 'default') ':' Statements ;
CommCase = ('case' SimpleStmt | 'default') ':' Statements ;
SimpleStmt = Expr | Expr '<-' Expr | Expr ('++' | '--') | Exprs AssignOp Exprs | Names ':=' Exprs ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
Exprs = Expr (',' Expr)* ;
Expr = Unary (BinaryOp Unary)* ;
BinaryOp = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
Unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-') Unary | Primary ;
Primary = Operand | Primary '.' NAME | Primary '.' '(' Type ')' | Primary '[' Expr (',' Type)* ','? ']' | Primary '[' Expr? ':' Expr? ']' | Primary '[' Expr? ':' Expr ':' Expr ']'
  | Primary '[' Type (',' Type)* ','? ']' | Primary '(' (CallArg (',' CallArg)* '...'? ','?)? ')' ;
CallArg = Expr | Type ;
Operand = NAME | NUMBER | STRING | CHAR | '(' Expr ')' | '(' Type ')' | 'func' Signature Block | LiteralType LiteralValue | Conversion ;
Conversion = ('[' ']' Type | '[' (Expr | '...') ']' Type | 'map' '[' Type ']' Type | 'chan' Type | 'interface' '{' '}' | 'func' Signature) '(' Expr ','? ')' ;
LiteralType = TypeName | '[' ']' Type | '[' (Expr | '...') ']' Type | 'map' '[' Type ']' Type | 'struct' '{' (Field (';' Field)* ';'?)? '}' ;
LiteralValue = '{' (Keyed (',' Keyed)* ','?)? '}' ;
Keyed = LiteralElement (':' LiteralElement)? ;
LiteralElement = Expr | LiteralValue ;
"""

JAVA = """
File = (Annotation* 'package' Dotted ';')? Import* TopLevel* ;
ModuleFile = Import* Annotation* 'open'? 'module' Dotted '{' Directive* '}' ;
Directive = 'requires' ('transitive' | 'static')* Dotted ';' | ('exports' | 'opens') Dotted ('to' Dotted (',' Dotted)*)? ';' | 'uses' Dotted ';' | 'provides' Dotted 'with' Dotted (',' Dotted)* ';' ;
Import = 'import' 'static'? Dotted ('.' '*')? ';' | ';' ;
TopLevel = TypeDecl | ';' ;
Dotted = NAME ('.' NAME)* ;
Modifier = Annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' ;
Annotation = '@' Dotted ('(' (ElementValue | Pair (',' Pair)*)? ')')? ;
Pair = NAME '=' ElementValue ;
ElementValue = Annotation | Conditional | '{' (ElementValue (',' ElementValue)*)? ','? '}' ;
TypeDecl = Modifier* (ClassDecl | InterfaceDecl | EnumDecl | RecordDecl | '@' 'interface' NAME ClassBody) ;
ClassDecl = 'class' NAME TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? ClassBody ;
InterfaceDecl = 'interface' NAME TypeParams? ('extends' Types)? ('permits' Types)? ClassBody ;
RecordDecl = 'record' NAME TypeParams? '(' Params? ')' ('implements' Types)? ClassBody ;
EnumDecl = 'enum' NAME ('implements' Types)? '{' (EnumConstant (',' EnumConstant)*)? ','? (';' Member*)? '}' ;
EnumConstant = Annotation* NAME Args? ClassBody? ;
ClassBody = '{' Member* '}' ;
Member = ';' | 'static'? Block | Modifier* (Method | Field | Constructor) | TypeDecl ;
Method = TypeParams? Annotation* (Type | 'void') NAME '(' Params? ')' Dims ('throws' Types)? ('default' ElementValue)? (Block | ';') ;
Constructor = TypeParams? NAME '(' Params? ')' ('throws' Types)? Block | NAME Block ;
Field = Type Declarator (',' Declarator)* ';' ;
Declarator = NAME Dims ('=' Initializer)? ;
Dims = (Annotation* '[' ']')* ;
Initializer = Expression | '{' (Initializer (',' Initializer)*)? ','? '}' ;
Params = Param (',' Param)* ;
Param = ParamModifier* Type ('...' | Annotation+ '...')? (NAME Dims | (NAME '.')? 'this') ;
ParamModifier = 'final' | Annotation ;
TypeParams = '<' TypeParam (',' TypeParam)* '>' ;
TypeParam = Annotation* NAME ('extends' Type ('&' Type)*)? ;
Types = Type (',' Type)* ;
Type = Annotation* (Primitive | ClassType) Dims ;
Primitive = 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double' ;
ClassType = NAME TypeArgs? ('.' Annotation* NAME TypeArgs?)* ;
TypeArgs = '<' (TypeArg (',' TypeArg)*)? '>' ;
TypeArg = Type | Annotation* '?' (('extends' | 'super') Type)? ;
Block = '{' BlockStatement* '}' ;
BlockStatement = LocalVar ';' | TypeDecl | Statement ;
LocalVar = ParamModifier* Type Declarator (',' Declarator)* ;
Statement = Block | ';' | NAME ':' Statement | StatementExpression ';' | 'if' '(' Expression ')' Statement ('else' Statement | @noelse) | 'assert' Expression (':' Expression)? ';'
  | Switch | 'while' '(' Expression ')' Statement | 'do' Statement 'while' '(' Expression ')' ';' | 'break' NAME? ';' | 'continue' NAME? ';' | 'yield' Expression ';'
  | 'return' Expression? ';' | 'throw' Expression ';' | 'synchronized' '(' Expression ')' Block
  | 'for' '(' ForInit? ';' Expression? ';' (Expression (',' Expression)*)? ')' Statement | 'for' '(' ParamModifier* Type NAME ':' Expression ')' Statement
  | 'try' Block (Catch+ Finally? | Finally) | 'try' '(' Resource (';' Resource)* ';'? ')' Block Catch* Finally? ;
ForInit = LocalVar | StatementExpression (',' StatementExpression)* ;
Catch = 'catch' '(' ParamModifier* Type ('|' Type)* NAME ')' Block ;
Finally = 'finally' Block ;
Resource = LocalVar | Postfix ;
StatementExpression = Postfix AssignOp Expression | ('++' | '--') Unary | Postfix ('++' | '--') | Postfix '.' TypeArgs? NAME Args | NAME Args | ('this' | 'super') Args | Postfix '.' 'super' Args | New | Postfix '.' New ;
Switch = 'switch' '(' Expression ')' '{' (SwitchGroup* | SwitchRule*) '}' ;
SwitchGroup = (SwitchLabel ':')+ BlockStatement* ;
SwitchRule = SwitchLabel '->' (Expression ';' | Block | 'throw' Expression ';') ;
SwitchLabel = 'case' CaseItem (',' CaseItem)* ('when' Expression)? | 'default' ;
CaseItem = Conditional | Pattern | 'default' ;
Pattern = ParamModifier* Type NAME | Type '(' (Pattern (',' Pattern)*)? ')' NAME? ;
Expression = Lambda | Conditional | Postfix AssignOp Expression ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' @glued '>' @glued '=' | '>' @glued '>' @glued '>' @glued '=' ;
Lambda = (NAME | '(' (Params | NAME (',' NAME)*)? ')') '->' (Expression | Block) ;
Conditional = Binary ('?' Expression ':' (Conditional | Lambda))? ;
Binary = Unary (BinaryOp Unary | 'instanceof' (Type | Pattern))* ;
BinaryOp = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>' @glued '=' | '<<' | '>' @glued '>' | '>' @glued '>' @glued '>' | '+' | '-' | '*' | '/' | '%' ;
Unary = ('+' | '-' | '++' | '--' | '~' | '!') Unary | '(' Type ('&' Type)* ')' (Unary | Lambda) | Postfix ('++' | '--')? | Switch ;
Postfix = PrimaryExpr | Postfix '.' TypeArgs? NAME Args? | Postfix '.' ('this' | 'class' | 'super') | Postfix '.' 'super' Args | Postfix '.' New | Postfix '[' Expression ']' | Postfix '::' TypeArgs? (NAME | 'new') ;
PrimaryExpr = NAME Args? | NUMBER | STRING | CHAR | 'true' | 'false' | 'null' | 'this' Args? | 'super' Args? | '(' Expression ')' | New
  | Primitive Dims '.' 'class' | 'void' '.' 'class' | NAME ('.' NAME)* ('[' ']')+ '.' 'class' | Type '::' TypeArgs? (NAME | 'new') ;
New = 'new' TypeArgs? Annotation* (ClassType Args ClassBody? | (Primitive | ClassType) (('[' Expression ']')+ Dims | ('[' ']')+ ArrayInit)) ;
ArrayInit = '{' (Initializer (',' Initializer)*)? ','? '}' ;
Args = '(' (Expression (',' Expression)*)? ')' ;
"""

# Words that begin or end a construct are no command names; as arguments they are words like others.
BASH = """
File = Gap List? ;
Gap = NEWLINE* ;
List = AndOr (Separator AndOr)* Separator? ;
Separator = ('&' | ';') Gap | NEWLINE Gap ;
AndOr = Pipeline (('&&' | '||') Gap Pipeline)* ;
Pipeline = ('!' | 'time')+ Pipe? | Pipe ;
Pipe = Command (('|' | '|&') Gap Command)* ;
Command = SimpleCommand | Compound Redirect* | Function | 'coproc' WORD? Compound Redirect* | 'coproc' SimpleCommand ;
SimpleCommand = Prefix+ (WORD Suffix*)? | COMMAND Suffix* ;
Prefix = ASSIGNMENT | Redirect | ARRAY '(' ArrayItems ')' ;
Suffix = WORD | Redirect | ASSIGNMENT | ARRAY '(' ArrayItems ')' ;
ArrayItems = (WORD | ASSIGNMENT | NEWLINE)* ;
Redirect = IO_NUMBER? ('<' | '>' | '>>' | '<<<' | '<&' | '>&' | '<>' | '>|') (WORD | ASSIGNMENT) | ('&>' | '&>>') WORD | IO_NUMBER? HEREDOC ;
Body = Gap List ;
Compound = '{' Body '}' | '(' Body ')' | 'if' Body 'then' Body ('elif' Body 'then' Body)* ('else' Body)? 'fi' | ('while' | 'until') Body 'do' Body 'done'
  | ('for' | 'select') WORD Gap ('in' WordOrAssign* (';' | NEWLINE) Gap | ';' Gap)? Loop | 'for' ARITHMETIC (';' | NEWLINE)? Gap Loop
  | 'case' WordOrAssign Gap 'in' Gap CaseItem* CaseLast? 'esac' | ARITHMETIC | TEST ;
WordOrAssign = WORD | ASSIGNMENT ;
Loop = 'do' Body 'done' | '{' Body '}' ;
CaseItem = CasePattern Gap List? (';;' | ';&' | ';;&') Gap ;
CaseLast = CasePattern Gap List? ;
CasePattern = '(' CaseWord ('|' CaseWord)* ')' | CASEWORD ('|' CaseWord)* ')' ;
CaseWord = WORD | ASSIGNMENT ;
Function = COMMAND '(' ')' Gap Compound Redirect* | 'function' WORD ('(' ')')? Gap Compound Redirect* ;
"""

YAML = """
File = Document0? (Explicit | DOCEND)* ;
Document0 = BlockNode ;
Explicit = Directives? DOCSTART BlockNode? ;
Directives = DIRECTIVE+ ;
BlockNode = ALIAS | Properties BlockContent? | BlockContent ;
BlockOrIndentless = ALIAS | Properties (BlockContent | Indentless)? | BlockContent | Indentless ;
Properties = ANCHOR TAG? | TAG ANCHOR? ;
BlockContent = BlockMapping | BlockSequence | FlowCollection | SCALAR ;
BlockSequence = SEQSTART (ENTRY BlockNode?)+ BLOCKEND ;
Indentless = (ENTRY BlockNode?)+ ;
BlockMapping = MAPSTART (KEY BlockOrIndentless? (VALUE BlockOrIndentless?)? | VALUE BlockOrIndentless?)+ BLOCKEND ;
FlowCollection = '[' (FlowSeqEntry (',' FlowSeqEntry)* ','?)? ']' | '{' (FlowMapEntry (',' FlowMapEntry)* ','?)? '}' ;
FlowSeqEntry = FlowNode | KEY FlowNode? (VALUE FlowNode?)? | VALUE FlowNode? ;
FlowMapEntry = FlowNode | KEY FlowNode? (VALUE FlowNode?)? | VALUE FlowNode? ;
FlowNode = ALIAS | Properties FlowContent? | FlowContent ;
FlowContent = FlowCollection | SCALAR ;
"""
