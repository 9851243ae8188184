"""What the extraction knows of each language, as rows: comments, strings, how a body ends, definitions and calls.

Fixed values: kinds are the names that other tables and questions use. A definition is (kind, pattern); the pattern runs over
text whose comments and strings are blank, with ^ and $ at lines, and its last group that took part is the name. Patterns
are in the re module's language, with WORD for a name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: How a literal opens and what its whole is. A heredoc and a raw string end by what they opened with.
LITERALS = {
    "double": (r'"', r'"(?:\\.|[^"\\])*(?:"|\Z)'), "single": (r"'", r"'(?:\\.|[^'\\])*(?:'|\Z)"), "tick": (r"`", r"`(?:\\.|[^`\\])*(?:`|\Z)"),
    "double_line": (r'"', r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)'), "single_line": (r"'", r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"),
    "doubled": (r'"', r'"(?:""|[^"])*(?:"|\Z)'), "singled": (r"'", r"'(?:''|[^'\n])*(?:'|(?=\n)|\Z)"),
    "char": (r"'(?:\\[^\n]+?|[^'\\\n])'", r"'(?:\\[^\n]+?|[^'\\\n])'"), "triple": (r'"""', r'"""(?:\\.|[^\\])*?(?:"""|\Z)'), "triple_single": (r"'''", r"'''(?:\\.|[^\\])*?(?:'''|\Z)"),
    "rust_raw": (r'\bb?r#*"', r'b?r(#*)".*?(?:"\1|\Z)'), "cpp_raw": (r'\bu?8?R"', r'u?8?R"([^(\n]*)\(.*?(?:\)\1"|\Z)'), "lua_long": (r"\[=*\[", r"\[(=*)\[.*?(?:\]\1\]|\Z)"),
    "heredoc": (r"<<[-~]?\s*(?P<q>['\"]?)[A-Za-z_]\w*(?P=q)", r"<<[-~]?\s*(['\"]?)([A-Za-z_]\w*)\1[^\n]*\n.*?(?:^[ \t]*\2\b|\Z)"), "php_heredoc": (r"<<<", r"<<<[ \t]*(['\"]?)(\w+)\1[^\n]*\n.*?(?:^[ \t]*\2\b|\Z)"),
    "here_string": (r"@(?P<h>['\"])\n", r"@(['\"])\n.*?(?:^\1@|\Z)"), "nix_indented": (r"''", r"''.*?(?:''(?![$'\\])|\Z)"), "verbatim": (r'@"', r'@"(?:""|[^"])*(?:"|\Z)'),
}

C_COMMENTS = (("//",), (("/*", "*/"),))
CONTROL = "if for while switch return catch sizeof else do case when unless until match with try throw new typeof await function def fn func fun defined and or not in is as elif except assert lambda yield foreach using lock fixed nameof catch delete void super import"
CALL = r"(?<![\w$@])(?<!new )(WORD)\s*\("
#: The start of a statement in shells, and where an applied function may stand in languages without parentheses.
SHELL_CALL = r"(?:^|[;|&({`]|\$\(|\b(?:then|do|else)\b)[ \t]*(?:(?:if|elif|while|until|and|or|not|then|do|else|time|begin)[ \t]+)*(?!\w+=)([A-Za-z_][\w./-]*)(?=[\s;|&)]|$)"
APPLIED = r"(?:[=($,\[;|>]|->|<-|\b(?:then|else|in|of|do|with)\b|^[ \t]+)[ \t\n]*(?:[A-Z]\w*\.)*([a-z_][\w']*)[ \t]+(?=[\w(\"\[{~'])"
COMMAND = r"(?:\.|&\.)([a-z_]\w*[?!]?)|(?<![\w.:@$])([a-z_]\w*[?!]?)\(|^[ \t]*([a-z_]\w*[?!]?)[ \t]+(?=[\"':@\w\[%~])"


@dataclass(frozen=True)
class Grammar:
    defs: tuple[tuple[str, str], ...]
    body: str = "brace"  # brace, end, indent, paren, stop (to a full stop), semicolon, line, header (to ;)
    call: str | None = CALL
    line: tuple[str, ...] = C_COMMENTS[0]
    block: tuple[tuple[str, str], ...] = C_COMMENTS[1]
    literals: tuple[str, ...] = ("double_line", "char")
    nested: bool = False  # block comments nest
    opens: str = ""  # body "end": what opens a block
    closes: str = r"\bend\b"
    reserved: str = CONTROL
    heads: bool = False  # a definition's head counts as a call as well
    word: str = r"[A-Za-z_]\w*"
    ignore_case: bool = False


RUBY_RESERVED = CONTROL + " class module end begin rescue ensure elsif alias undef struct lib enum macro abstract"
HASH = {"line": ("#",), "block": ()}
DASH = {"line": ("--",), "block": ()}
_C_FUNCTION = ("function_definition", r"^[ \t]*(?:(?!(?:return|else|new|throw|case|goto|typedef|using|delete)\b)[A-Za-z_](?:\w|::|[<>,])*[\s*&]+)+(WORD)\s*\([^;{}]*\)[^;{}()]*(?=\{)")
_C_STRUCT = ("struct_specifier", r"\bstruct[ \t]+(WORD)(?=[^;(){}=]*\{)")
_JS_FUNCTION = ("function_declaration", r"\bfunction[ \t]*(?!\*)(WORD)\s*(?:<[^>(]*>)?\(")
_JS_METHOD = ("method_definition", r"^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)[ \t]+)*\*?[ \t]*(?!(?:if|for|while|switch|catch|function|return|with)\b)(#?WORD)\s*(?:<[^>(]*>)?\([^;{}]*\)\s*(?::[^;{}=]+)?(?=\{)")
_JAVA_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|virtual|override|async|synchronized|default|native|readonly|unsafe|extern|strictfp)[ \t]+)*"
_JAVA_METHOD = ("method_declaration", rf"^[ \t]*{_JAVA_MODS}(?:<[^>]*>[ \t]*)?(?!(?:return|new|else|throw|case|def|class|record|await|yield)\b)[A-Za-z_][\w.<>,\[\]?]*(?:[ \t]+[\w.<>,\[\]?]+)*[ \t]+(WORD)\s*\([^;{{}}]*\)[^;{{}}()=]*(?=[{{;]|=>)")
_JAVA_CONSTRUCTOR = ("constructor_declaration", rf"^[ \t]*(?:(?:public|private|protected|internal)[ \t]+)+(WORD)\s*\([^;{{}}]*\)[^;{{}}=]*(?=\{{)")


def _named(kind: str, words: str, name: str = "WORD") -> tuple[str, str]:
    return kind, rf"\b(?:{words})\s+({name})"


_LISP_RESERVED = "define lambda if cond let let* letrec begin when unless set! quote quasiquote unquote and or not else case do define-syntax struct define-struct module require provide import export"
GRAMMARS: dict[str, Grammar] = {
    "rust": Grammar((_named("function_item", "fn"), _named("struct_item", "struct"), _named("enum_item", "enum"), _named("trait_item", "trait"), _named("mod_item", "mod"), ("impl_item", r"\bimpl\b(?:\s*<[^{]*?>)?(?:[^{;]*?\bfor)?\s+(?:&\s*)?(?:WORD::)*(WORD)(?=[^{;]*\{)")), call=r"(?<![\w$])(WORD)\s*(?:!\s*[(\[{]|(?:::<[^;()]*>)?\()", literals=("rust_raw", "double", "char"), nested=True),
    "javascript": Grammar((_JS_FUNCTION, _named("class_declaration", "class"), _JS_METHOD), literals=("double_line", "single_line", "tick"), word=r"[A-Za-z_$][\w$]*"),
    "typescript": Grammar((_JS_FUNCTION, _named("class_declaration", "class"), _JS_METHOD, _named("interface_declaration", "interface")), literals=("double_line", "single_line", "tick"), word=r"[A-Za-z_$][\w$]*"),
    "c": Grammar((_C_FUNCTION, _C_STRUCT)),
    "cpp": Grammar((_C_FUNCTION, _C_STRUCT, ("class_specifier", r"\bclass[ \t]+(WORD)(?=[^;(){}=]*\{)")), literals=("cpp_raw", "double_line", "char")),
    "glsl": Grammar((_C_FUNCTION, _C_STRUCT)), "hlsl": Grammar((_C_FUNCTION, _C_STRUCT)),
    "go": Grammar((("function_declaration", r"^func\s+(WORD)"), ("method_declaration", r"^func\s*\([^)]*\)\s*(WORD)"), ("type_spec", r"^type\s+(WORD)|^[ \t]+(WORD)\s+(?:struct|interface)(?=\s*\{)")), literals=("double_line", "tick", "char")),
    "java": Grammar((_named("class_declaration", "class"), ("interface_declaration", r"(?<!@)\binterface\s+(WORD)"), _JAVA_METHOD, _JAVA_CONSTRUCTOR, _named("enum_declaration", "enum"), ("record_declaration", r"\brecord\s+(WORD)(?=\s*[<(])")), literals=("triple", "double_line", "char")),
    "csharp": Grammar((_named("class_declaration", "class"), _named("interface_declaration", "interface"), _JAVA_METHOD, _JAVA_CONSTRUCTOR, _named("enum_declaration", "enum"), _named("struct_declaration", "struct"), ("record_declaration", r"\brecord\s+(?:class\s+)?(WORD)(?=\s*[({;:])")), literals=("verbatim", "double_line", "char")),
    "php": Grammar((_named("class_declaration", "class"), _named("interface_declaration", "interface"), _named("trait_declaration", "trait"), ("method_declaration", r"^[ \t]+(?:(?:public|private|protected|static|final|abstract)[ \t]+)+function\s+&?(WORD)"), ("function_definition", r"^[ \t]*function\s+&?(WORD)"), _named("enum_declaration", "enum")), line=("//", "#"), literals=("php_heredoc", "double", "single"), reserved=CONTROL + " include include_once require require_once echo print array list isset empty unset"),
    "ruby": Grammar((("class", r"^[ \t]*class\s+(?:[A-Z]\w*::)*([A-Z]\w*)"), ("module", r"^[ \t]*module\s+(?:[A-Z]\w*::)*([A-Z]\w*)"), ("singleton_method", r"\bdef\s+(?:self|[A-Z]\w*)\.(\w+[?!=]?)"), ("method", r"\bdef\s+(?!self\.|[A-Z]\w*\.)(\w+[?!=]?)")), "end", COMMAND, ("#",), (("\n=begin", "\n=end"),), ("heredoc", "double", "single", "tick"), opens=r"^[ \t]*(?:if|unless|while|until|case|for|begin)\b|(?<=[=(])[ \t]*(?:if|unless|case|begin)\b|\b(?:class|module|def|do)\b(?!:)", reserved=RUBY_RESERVED),
    "crystal": Grammar((("method_def", r"\bdef\s+(?:self\.)?(\w+[?!=]?)"), ("class_def", r"^[ \t]*(?:abstract\s+)?class\s+(?:[A-Z]\w*::)*([A-Z]\w*)")), "end", COMMAND, ("#",), (), ("heredoc", "double", "char"), opens=r"^[ \t]*(?:if|unless|while|until|case|begin)\b|(?<=[=(])[ \t]*(?:if|unless|case|begin)\b|\b(?:class|module|struct|def|do|lib|enum|macro)\b(?!:)", reserved=RUBY_RESERVED),
    "bash": Grammar((("function_definition", r"^[ \t]*function\s+([\w.:-]+)\s*(?:\(\s*\))?|^[ \t]*([\w.:-]+)\s*\(\s*\)"),), call=SHELL_CALL, literals=("heredoc", "double", "singled"), reserved="if then else elif fi for while until do done case esac function in select time local return export declare readonly let coproc", **HASH),
    "fish": Grammar((("function_definition", r"^[ \t]*function\s+([\w.-]+)"),), "end", SHELL_CALL, ("#",), (), ("double", "single"), opens=r"^[ \t]*(?:function|if|for|while|switch|begin)\b|(?<=;)[ \t]*(?:if|for|while|begin)\b", reserved="if else for while switch case begin end function in and or not"),
    "lua": Grammar((("function_declaration", r"\bfunction\s+([A-Za-z_][\w.:]*)\s*\("),), "end", CALL, ("--",), (("--[[", "]]"),), ("lua_long", "double_line", "single_line"), opens=r"\b(?:function|if|do|repeat)\b", closes=r"\b(?:end|until)\b"),
    "solidity": Grammar((_named("contract_declaration", "contract"), _named("interface_declaration", "interface"), _named("library_declaration", "library"), _named("function_definition", "function"), _named("struct_declaration", "struct"), _named("enum_declaration", "enum"), _named("modifier_definition", "modifier")), literals=("double_line", "single_line"), reserved=CONTROL + " require2 mapping returns constructor modifier"),
    "kotlin": Grammar((("function_declaration", r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(WORD)"), ("class_declaration", r"\b(?:class|interface)\s+(WORD)")), call=None, literals=("triple", "double_line", "char"), nested=True),
    "powershell": Grammar((("function_statement", r"^[ \t]*(?:function|filter)\s+([\w:-]+)"), _named("class_statement", "class"), ("class_method_definition", r"^[ \t]+(?:(?:static|hidden)\s+)*\[[\w.\[\]]+\]\s*(WORD)\s*\([^;{}]*\)\s*(?=\{)")), call=r"(?:^|[;|{(=]|&)[ \t]*([A-Za-z][\w-]*)(?=[\s;|)}]|$)", line=("#",), block=(("<#", "#>"),), literals=("here_string", "double", "singled"), reserved="if else elseif foreach for while do until switch return function filter param begin process end try catch finally throw class enum using in break continue exit static hidden", ignore_case=True),
    "haskell": Grammar((("function", r"^([a-z_][\w']*)[ \t]+(?![=:|,])[^=:|\n]*(?:=(?!=)|\|)"), ("data_type", r"^data\s+([A-Z][\w']*)"), ("class", r"^class\s+(?:[^=\n]*=>\s*)?([A-Z][\w']*)")), "indent", APPLIED, ("--",), (("{-", "-}"),), ("double", "char"), nested=True, reserved="if then else case of let in where do data type class instance module import deriving newtype infix infixl infixr forall"),
    "dart": Grammar((("method_declaration", r"^[ \t]+(?:(?:static|final|abstract|external|@override)\s+)*(?!(?:return|new|else|throw|await|if|for|while|switch|catch)\b)[A-Za-z_][\w<>,?]*[ \t]+(?:get[ \t]+|set[ \t]+)?(WORD)\s*\([^;{}]*\)\s*(?:async\*?\s*)?(?=\{|=>)"), ("function_declaration", r"^(?!(?:return|class|if|for|while)\b)[A-Za-z_][\w<>,?]*[ \t]+(WORD)\s*\([^;{}]*\)\s*(?:async\*?\s*)?(?=\{|=>)"), _named("class_declaration", "class")), literals=("triple", "triple_single", "double_line", "single_line")),
    "zig": Grammar((_named("function_declaration", "fn"), ("variable_declaration", r"\bconst\s+(WORD)\s*=\s*(?:extern\s+|packed\s+)?struct\b")), line=("//",), block=()),
    "julia": Grammar((("function_definition", r"^[ \t]*function\s+(WORD!?)\s*\("), ("macro_definition", r"^[ \t]*macro\s+(WORD)\s*\("), ("struct_definition", r"^[ \t]*(?:mutable\s+)?struct\s+(WORD)")), "end", r"(?<![\w.@])(WORD!?)\(|\.(WORD!?)\(", ("#",), (("#=", "=#"),), ("triple", "double", "char"), True, r"\b(?:function|macro|struct|if|for|while|begin|let|try|module|quote|do)\b", heads=True),
    "groovy": Grammar((("function_definition", r"^(?:def|[A-Za-z_][\w.<>\[\]]*)[ \t]+(?!(?:class|interface|enum)\b)(WORD)\s*\([^;{}]*\)\s*(?=\{)"), _named("class_declaration", "class"), ("method_declaration", rf"^[ \t]+{_JAVA_MODS}(?:def|void|[A-Z][\w.<>\[\]]*|int|long|boolean|double)[ \t]+(WORD)\s*\([^;{{}}]*\)\s*(?=\{{)")), literals=("triple", "triple_single", "double_line", "single_line")),
    "graphql": Grammar((("object_type_definition", r"^[ \t]*type\s+(WORD)"), ("interface_type_definition", r"^[ \t]*interface\s+(WORD)"), ("input_object_type_definition", r"^[ \t]*input\s+(WORD)"), ("field_definition", r"^[ \t]+(WORD)\s*(?:\([^)]*\))?\s*:")), "brace", None, ("#",), (), ("triple", "double_line")),
    "d": Grammar((("function_declaration", _C_FUNCTION[1]), _named("class_declaration", "class"), ("struct_declaration", r"\bstruct\s+(WORD)")), block=(("/*", "*/"), ("/+", "+/")), literals=("double", "tick", "char")),
    "asm": Grammar((("label", r"^[ \t]*([A-Za-z_.$][\w.$]*):"),), "line", r"^[^\n]*?\b(?:callq?|jmp|jn?[ez]|j[lgab]e?|loop)[ \t]+([A-Za-z_.$][\w.$]*)", ("#", ";", "//"), (("/*", "*/"),), ("double_line",), reserved="", ignore_case=True),
    "elixir": Grammar((("call", r"\bdefmodule\s+([A-Z][\w.]*)|\bdef(?:p|macro|macrop)?[ \t]+([a-z_]\w*[?!]?)(?=[ \t]*(?:\([^\n]*|when[^\n]*)?,?[ \t\n]*do\b)"),), "end", COMMAND, ("#",), (), ("triple", "double", "single"), opens=r"\bdo\b(?!:)|\bfn\b", reserved="def defp defmacro defmacrop defmodule if unless case cond receive try with for do end fn when alias import require use and or not in else rescue after catch", heads=True),
    "scala": Grammar((("function_definition", r"\bdef\s+(WORD)(?=[^=\n{}]*(?:=|\{))"), ("function_declaration", r"\bdef\s+(WORD)(?=[^=\n{}]*$)"), ("object_definition", r"\bobject\s+(WORD)"), ("class_definition", r"\bclass\s+(WORD)"), ("trait_definition", r"\btrait\s+(WORD)")), literals=("triple", "double_line", "char"), nested=True),
    "swift": Grammar((_named("function_declaration", "func"), ("class_declaration", r"\b(?:class|struct|enum|actor)\s+(?!func\b|var\b|let\b)(WORD)")), literals=("triple", "double_line"), nested=True),
    "perl": Grammar((("function_definition", r"^[ \t]*sub\s+(WORD)"), ("package_statement", r"^[ \t]*package\s+(?:WORD::)*(WORD)")), call=r"->(WORD)|(?<![\w$@%&>:])(WORD)\s*\(", line=("#",), block=(("\n=pod", "\n=cut"), ("\n=head", "\n=cut")), literals=("heredoc", "double", "single"), reserved=CONTROL + " my our local qw sub elsif"),
    "r": Grammar((("binary_operator", r"([A-Za-z.][\w.]*)\s*(?:<<?-|=)\s*function\b"),), word=r"[A-Za-z.][\w.]*", literals=("double", "single"), **HASH),
    "ocaml": Grammar((("let_binding", r"\b(?:let|and)\s+(?:rec\s+)?([a-z_][\w']*)(?=[^\n]*=)"), ("module_binding", r"\bmodule\s+([A-Z][\w']*)"), ("type_binding", r"\btype\s+(?:(?:'\w+|\([^)]*\))\s+)?([a-z_][\w']*)")), "indent", APPLIED, (), (("(*", "*)"),), ("double", "char"), True, reserved="let rec in and if then else match with fun function begin end module struct sig type of open val while for do done to downto try when mutable method object class"),
    "elm": Grammar((("value_declaration", r"^([a-z]\w*)[ \t]*[^=:\n]*=(?!=)"), ("type_alias_declaration", r"^type\s+alias\s+([A-Z]\w*)")), "indent", APPLIED, ("--",), (("{-", "-}"),), ("triple", "double_line", "char"), True, reserved="if then else case of let in type alias module import exposing port as"),
    "nim": Grammar((("proc_declaration", r"^[ \t]*proc\s+(WORD)"), ("func_declaration", r"^[ \t]*func\s+(WORD)")), "indent", line=("#",), block=(("#[", "]#"),), literals=("triple", "double_line", "char"), nested=True, reserved=CONTROL + " proc func method iterator template macro of discard"),
    "erlang": Grammar((("function_clause", r"(?:^|(?<=;\n))([a-z][\w@]*)\s*\((?=[^\n]*(?:->|when))"), ("module_attribute", r"^-\s*module\s*\(\s*([a-z][\w@]*)")), "stop", r"(?<![\w:?@-])([a-z][\w@]*)\s*\(", ("%",), (), ("double", "single"), reserved="fun if case receive begin end try catch of when after andalso orelse not module export include define record spec type"),
    "vim": Grammar((("function_definition", r"^[ \t]*fu(?:n(?:c(?:t(?:i(?:on?)?)?)?)?)?!?\s+([\w:#.]+)"),), "end", r"(?<![\w.])([A-Za-z_][\w:#]*)\(", (), (('\n"', "\n"),), ("double_line", "singled"), opens=r"^[ \t]*fu(?:n|nc|nct|ncti|nctio|nction)?\b", closes=r"^[ \t]*endf(?:u|un|unc|unct|uncti|unctio|unction)?\b"),
    "nix": Grammar((("binding", r"(?<![\w.-])([A-Za-z_][\w'-]*)\s*=\s*(?=(?:\{[^{}]*\}|[A-Za-z_]\w*)(?:\s*@\s*\w+)?\s*:(?!:))"),), "semicolon", r"(?:[=(:;]|\b(?:in|then|else)\b)\s*(?!(?:in|then|else|let|if|with|inherit|rec|assert|or)\b)([A-Za-z_][\w'-]*)[ \t]+(?=[\w(\"\[{./])", ("#",), (("/*", "*/"),), ("nix_indented", "double"), reserved="let in if then else with inherit rec assert or"),
    "hcl": Grammar((("block", r"^[ \t]*[A-Za-z_][\w-]*[ \t]+\"([^\"\n]*)\"[^\n{=]*(?=\{)"),), line=("#", "//"), literals=("heredoc", "double_line")),
    "cmake": Grammar((("function_def", r"^[ \t]*function\s*\(\s*([^\s)]+)"), ("macro_def", r"^[ \t]*macro\s*\(\s*([^\s)]+)")), "end", r"^[ \t]*(WORD)[ \t]*\(", ("#",), (("#[[", "]]"),), ("double",), opens=r"^[ \t]*(?:function|macro)\s*\(", closes=r"^[ \t]*end(?:function|macro)\b", reserved="if elseif else endif foreach endforeach while endwhile function endfunction macro endmacro", ignore_case=True),
    "verilog": Grammar((("module_header", r"^[ \t]*module\s+(WORD)"), ("function_declaration", r"^[ \t]*function\b[^;\n(]*?(WORD)\s*(?=[;(])")), "header", r"(?:^|[=;,(+*/!&|?:<>-]|\bbegin\b|\belse\b)[ \t]*(\$?WORD)\s*\(", literals=("double_line",), reserved=CONTROL + " always initial begin assign module function posedge negedge or repeat wait"),
    "vhdl": Grammar((("entity_declaration", r"^[ \t]*entity\s+(WORD)\s+is\b"), ("architecture_definition", r"^[ \t]*architecture\s+(WORD)\s+of\b")), "end", r"(?:^|;|\bthen\b|\belse\b|\bbegin\b)[ \t]*(WORD)[ \t]*(?:\([^;()]*(?:\([^()]*\)[^;()]*)*\))?[ \t]*;", ("--",), (("/*", "*/"),), ("doubled", "char"), opens=r"^[ \t]*(?:entity|architecture|process|component|case|block)\b|^[ \t]*if\b|:[ \t]*process\b|\b(?:loop|generate)\b|^[ \t]*function\b[^;]*\bis\b|^[ \t]*procedure\b[^;]*\bis\b", closes=r"\bend\b[^;]*;", reserved="begin end is null return wait exit next process else port generic map", ignore_case=True),
    "fortran": Grammar((("function", r"^[ \t]*(?:(?!end\b)[\w()*=, \t]+[ \t])?function\s+(WORD)"), ("subroutine", r"^[ \t]*(?:(?:pure|elemental|recursive|impure)\s+)*subroutine\s+(WORD)"), ("module", r"^[ \t]*module\s+(?!procedure\b)(WORD)")), "end", r"\bcall\s+(WORD)|(?<![\w%])(?!call\b)(WORD)\s*\(", ("!",), (), ("doubled", "singled"), opens=r"^[ \t]*(?:(?!end\b)[\w()*=, \t]+[ \t])?(?:function|subroutine)\s+\w|^[ \t]*module\s+(?!procedure\b)\w|^[ \t]*program\s+\w", closes=r"^[ \t]*end[ \t]*(?:function|subroutine|module|program)\b|^[ \t]*end[ \t]*$", reserved="if while do call read write print allocate deallocate integer real character logical dimension intent kind len function subroutine select case where forall type class end result", ignore_case=True),
    "prolog": Grammar((("clause", r"(?:^|(?<=\.\n))([a-z]\w*)\s*\((?=[^\n]*)"),), "stop", r"(?<![\w:])([a-z]\w*)\(", ("%",), (("/*", "*/"),), ("double", "single"), reserved="", heads=True),
    "racket": Grammar((("list", r"\((?:define|struct|define-struct)\s+\(?([^\s()\[\]]+)"),), "paren", r"[(\[]\s*([^\s()\[\]'\"`,#;]+)", (";",), (("#|", "|#"),), ("double",), True, reserved=_LISP_RESERVED, heads=True),
    "scheme": Grammar((("list", r"\(define\s+\(?([^\s()\[\]]+)"),), "paren", r"[(\[]\s*([^\s()\[\]'\"`,#;]+)", (";",), (("#|", "|#"),), ("double",), True, reserved=_LISP_RESERVED, heads=True),
    "proto": Grammar((("message", r"\bmessage\s+(WORD)"), ("service", r"\bservice\s+(WORD)"), ("rpc", r"\brpc\s+(WORD)")), call=None, literals=("double_line", "single_line")),
    "objc": Grammar((("class_interface", r"^[ \t]*@interface\s+(WORD)"), ("class_implementation", r"^[ \t]*@implementation\s+(WORD)"), ("method_definition", r"^[-+]\s*\([^)]*\)\s*(WORD)(?=[^;{}]*\{)"), ("method_declaration", r"^[-+]\s*\([^)]*\)\s*(WORD)(?=[^;{}]*;)"), _C_FUNCTION), call=r"(?<![\w$@-])(WORD)\s*\(|(?<=[\w\]])[ \t]+(WORD)(?=[ \t]*[\]:])", literals=("double_line", "char")),
    "ada": Grammar((("package_body", r"^[ \t]*package\s+body\s+(?:WORD\.)*(WORD)"), ("package_declaration", r"^[ \t]*package\s+(?!body\b)(?:WORD\.)*(WORD)"), ("subprogram_body", r"^[ \t]*(?:function|procedure)\s+(WORD)(?=[^;]*?\bis\b(?!\s+(?:new|abstract|separate)\b))"), ("subprogram_declaration", r"^[ \t]*(?:function|procedure)\s+(WORD)(?=(?:(?!\bis\b)[^;(]|\([^)]*\))*;)")), "end", r"(?:^|;|\bthen\b|\belse\b|\bbegin\b|\bloop\b)[ \t\n]*(?:WORD\.)*(WORD)[ \t]*(?:\([^;()]*(?:\([^()]*\)[^;()]*)*\))?[ \t]*;", ("--",), (), ("doubled", "char"), opens=r"^[ \t]*package\b|^[ \t]*(?:function|procedure)\b[^;]*?\bis\b(?!\s+(?:new|abstract|separate)\b)|^[ \t]*(?:if|case|declare|task|record)\b|\bloop\b|\brecord\b", closes=r"\bend\b[^;]*;", reserved="begin end is null return exit loop else private", ignore_case=True),
    "wgsl": Grammar((("function_declaration", r"\bfn\s+(WORD)"), ("struct_declaration", r"\bstruct\s+(WORD)")), call=None, literals=(), nested=True),
    "latex": Grammar((("section", r"\\(?:sub)*section\*?\s*\{([^{}]*)\}"), ("label_definition", r"\\label\s*\{([^{}]*)\}")), "line", None, ("%",), (), ()),
}
GRAMMARS["tsx"] = GRAMMARS["typescript"]


@dataclass(frozen=True)
class Compiled:
    grammar: Grammar
    opener: re.Pattern | None
    literals: dict[str, re.Pattern]
    defs: tuple[tuple[str, re.Pattern], ...]
    call: re.Pattern | None
    reserved: frozenset[str]
    blocks: re.Pattern | None


def compiled(g: Grammar) -> Compiled:
    flags = re.M | (re.I if g.ignore_case else 0)
    p = lambda x: re.compile(x.replace("WORD", g.word), flags)
    parts = [rf"(?P<b{i}>{re.escape(o)})" for i, (o, _) in enumerate(g.block)]
    parts += [rf"(?P<l{i}>{'(?<![&$])' if s == '#' and g.body == 'brace' else ''}{re.escape(s)})" for i, s in enumerate(g.line)]
    parts += [rf"(?P<{name}>{LITERALS[name][0]})" for name in g.literals]
    whole = {name: re.compile(LITERALS[name][1], re.S | re.M) for name in g.literals}
    blocks = re.compile(rf"(?P<close>{g.closes})|(?P<open>{g.opens})", flags) if g.opens else None
    return Compiled(g, re.compile("|".join(parts)) if parts else None, whole, tuple((k, p(x)) for k, x in g.defs), p(g.call) if g.call else None, frozenset(g.reserved.lower().split() if g.ignore_case else g.reserved.split()), blocks)


COMPILED = {lang: compiled(g) for lang, g in GRAMMARS.items()}
