"""A small file of each language with what must be found in it: symbols (kind, name, first line, last line), calls
(name, line) and imports (path, name, wildcard). Comments and strings hold decoys."""

FILES = {
    "rust": ('use crate::store::{self, page::{Page, Slot as S}, wal::*};\nmod inner {\n    use super::open;\n}\n// fn decoy() {}\npub struct Tree<T> {\n    root: T,\n}\nimpl<T> Tree<T> {\n    pub fn walk(&self) -> u32 {\n        let s = r#"fn raw() { call() }"#;\n        println!("{}", s);\n        visit::<u8>(self.root.len())\n    }\n}\nenum Kind { A, B }\ntrait Shape {\n    fn area(&self) -> f64;\n}\n',
        [("mod_item", "inner", 2, 4), ("struct_item", "Tree", 6, 8), ("impl_item", "Tree", 9, 15), ("function_item", "walk", 10, 14), ("enum_item", "Kind", 16, 16), ("trait_item", "Shape", 17, 19), ("function_item", "area", 18, 18)],
        [("println", 12), ("visit", 13), ("len", 13)],
        [("crate::store::self", "self", False), ("crate::store::page::Page", "Page", False), ("crate::store::page::Slot", "Slot", False), ("crate::store::wal::*", None, True), ("super::open", "open", False)]),
    "python": ("import os.path as p\nfrom ..core import run, stop as halt\nfrom shapes import *\n\nclass Box(Base):\n    def size(self):\n        return area(self.w)  # decoy()\n\nx = Box().size()\n",
        [("class_definition", "Box", 5, 7), ("function_definition", "size", 6, 7)], [("area", 7), ("Box", 9), ("size", 9)], [("os.path", None, False), ("..core", "run", False), ("..core", "stop", False), ("shapes.*", None, True)]),
    "javascript": ("import Main, { draw as d, wipe } from './canvas';\nimport * as all from '../all';\nimport './side.css';\n/* function decoy() {} */\nfunction paint(x) {\n  return draw(x, `t ${1}`);\n}\nclass Brush {\n  stroke(a) {\n    if (a) { this.ink.flow(a); }\n  }\n}\n",
        [("function_declaration", "paint", 5, 7), ("class_declaration", "Brush", 8, 12), ("method_definition", "stroke", 9, 11)], [("draw", 6), ("flow", 10)],
        [("./canvas", None, False), ("./canvas", "draw", False), ("./canvas", "wipe", False), ("../all", None, False), ("./side.css", None, False)]),
    "typescript": ("import type { Row } from './rows';\nexport interface Sink<T> {\n  put(x: T): void;\n}\nexport class Pipe<T> implements Sink<T> {\n  async put(x: T): Promise<void> {\n    await send(x);\n  }\n}\nexport function wire<A>(a: A): A { return tie(a) }\n",
        [("interface_declaration", "Sink", 2, 4), ("class_declaration", "Pipe", 5, 9), ("method_definition", "put", 6, 8), ("function_declaration", "wire", 10, 10)], [("put", 3), ("send", 7), ("tie", 10)], [("./rows", "Row", False)]),
    "tsx": ("import { Icon } from './icon';\nfunction View() {\n  return <Icon onClick={() => fire()} />;\n}\n", [("function_declaration", "View", 2, 4)], [("fire", 3)], [("./icon", "Icon", False)]),
    "c": ('#include "list.h"\n#include <stdio.h>\nstruct node {\n  int v;\n};\nint push(struct node *n, int v);\nstatic int\n  pop(struct node *n) {\n  return 0;\n}\nint push(struct node *n, int v) {\n  printf("push(%d)", v); /* pop(n) */\n  return grow(n);\n}\n',
        [("struct_specifier", "node", 3, 5), ("function_definition", "pop", 7, 10), ("function_definition", "push", 11, 14)], [("printf", 12), ("grow", 13)], [("list.h", None, False)]),
    "cpp": ('#include "shape.hpp"\nclass Disk : public Shape {\n public:\n  double area() const { return mul(r, r); }\n};\nint main() {\n  auto s = R"x(fake())x";\n  disk.draw();\n  return geo::run(s);\n}\n',
        [("class_specifier", "Disk", 2, 5), ("function_definition", "area", 4, 4), ("function_definition", "main", 6, 10)], [("mul", 4), ("draw", 8), ("run", 9)], [("shape.hpp", None, False)]),
    "glsl": ('#include "noise.glsl"\nstruct Light { vec3 p; };\nvoid main() {\n  gl = shade(1.0);\n}\n', [("struct_specifier", "Light", 2, 2), ("function_definition", "main", 3, 5)], [("shade", 4)], [("noise.glsl", None, False)]),
    "hlsl": ('#include "common.fx"\nfloat4 ps(float4 p)\n{\n  return tint(p);\n}\n', [("function_definition", "ps", 2, 5)], [("tint", 4)], [("common.fx", None, False)]),
    "objc": ('#import "Cell.h"\n@interface Cell : NSObject\n- (int)width;\n@end\n@implementation Cell\n- (int)width {\n  return [self measure];\n}\n@end\n',
        [("class_interface", "Cell", 2, 2), ("method_declaration", "width", 3, 3), ("class_implementation", "Cell", 5, 5), ("method_definition", "width", 6, 8)], [("measure", 7)], [("Cell.h", None, False)]),
    "go": ('package m\nimport (\n\t"fmt"\n\tu "app/util"\n)\nimport "os"\ntype Set struct {\n\tn int\n}\nfunc New() *Set {\n\treturn make2(1)\n}\nfunc (s *Set) Add(x int) {\n\tfmt.Println("f()", x)\n}\n',
        [("type_spec", "Set", 7, 9), ("function_declaration", "New", 10, 12), ("method_declaration", "Add", 13, 15)], [("make2", 11), ("Println", 14)], [("fmt", None, True), ("app/util", None, True), ("os", None, True)]),
    "java": ("import java.util.List;\nimport static a.b.C.*;\npublic class Cart {\n  public Cart(int n) {\n    init(n);\n  }\n  int total(List<Item> xs) throws E {\n    Item i = new Item(3);\n    return xs.size();\n  }\n  enum Unit { KG }\n  record Pair(int a, int b) {}\n}\ninterface Priced {\n  int price();\n}\n",
        [("class_declaration", "Cart", 3, 13), ("constructor_declaration", "Cart", 4, 6), ("method_declaration", "total", 7, 10), ("enum_declaration", "Unit", 11, 11), ("record_declaration", "Pair", 12, 12), ("interface_declaration", "Priced", 14, 16), ("method_declaration", "price", 15, 15)],
        [("init", 5), ("size", 9)], [("java.util.List", "List", False), ("a.b.C.*", None, True)]),
    "csharp": ('using System.Text;\nnamespace N {\n  public class Box {\n    public Box(int n) { Fill(n); }\n    public int Area(int w) => Mul(w, @"x(y)");\n    struct P { }\n  }\n  interface IBox { }\n  enum E { A }\n  record R(int a);\n}\n',
        [("class_declaration", "Box", 3, 7), ("constructor_declaration", "Box", 4, 4), ("method_declaration", "Area", 5, 5), ("struct_declaration", "P", 6, 6), ("interface_declaration", "IBox", 8, 8), ("enum_declaration", "E", 9, 9), ("record_declaration", "R", 10, 10)], [("Fill", 4), ("Mul", 5)], [("System.Text", "Text", False)]),
    "php": ("<?php\nrequire_once 'db.php';\ninclude($path);\ninterface Log {}\ntrait Loud {}\nenum Level { }\nclass User {\n  public function name($x) {\n    return trim($this->load($x)); # fake()\n  }\n}\nfunction helper() {\n  return User::make(1);\n}\n",
        [("interface_declaration", "Log", 4, 4), ("trait_declaration", "Loud", 5, 5), ("enum_declaration", "Level", 6, 6), ("class_declaration", "User", 7, 11), ("method_declaration", "name", 8, 10), ("function_definition", "helper", 12, 14)], [("trim", 9), ("load", 9), ("make", 13)], [("db.php", None, False)]),
    "ruby": ("require 'json'\nrequire_relative './cart'\nmodule Shop\n  class Cart\n    def self.open(id)\n      find(id) if id\n    end\n    def total\n      items.each do |i|\n        puts \"end\"\n      end\n      x = if ok then 1 else 2 end\n    end\n  end\nend\n",
        [("module", "Shop", 3, 15), ("class", "Cart", 4, 14), ("singleton_method", "open", 5, 7), ("method", "total", 8, 13)], [("require", 1), ("require_relative", 2), ("find", 6), ("each", 9), ("puts", 10)], [("json", None, False), ("./cart", None, False)]),
    "crystal": ('require "./util"\nclass Job\n  def run(x)\n    log.info("end")\n    if x\n      stop(x)\n    end\n  end\nend\n', [("class_def", "Job", 2, 9), ("method_def", "run", 3, 8)], [("require", 1), ("info", 4), ("stop", 6)], [("./util", None, False)]),
    "bash": ('source ./lib.sh\n. "./env.sh"\nbuild() {\n  cat <<EOF\nfake() { }\nEOF\n  make all && deploy_it "$1"  # rm\n}\nfunction clean {\n  rm -rf out\n}\nX=1\nbuild\n',
        [("function_definition", "build", 3, 8), ("function_definition", "clean", 9, 11)], [("source", 1), ("cat", 4), ("make", 7), ("deploy_it", 7), ("rm", 10), ("build", 13)], [("./lib.sh", None, False), ("./env.sh", None, False)]),
    "fish": ("source ./conf.fish\nfunction greet\n  if test -n x\n    echo hi\n  end\nend\ngreet\n", [("function_definition", "greet", 2, 6)], [("source", 1), ("test", 3), ("echo", 4), ("greet", 7)], [("./conf.fish", None, False)]),
    "lua": ('local m = require("pkg.util")\n--[[ function decoy() end ]]\nfunction M.go(x)\n  if x then m.run(x) end\n  for i = 1, 2 do obj:step(i) end\n  return [==[ fake() ]==]\nend\nlocal function two() return 2 end\n',
        [("function_declaration", "M.go", 3, 7), ("function_declaration", "two", 8, 8)], [("require", 1), ("run", 4), ("step", 5)], [("pkg.util", None, False)]),
    "solidity": ('import "./Base.sol";\nimport {A} from "./A.sol";\ninterface I { }\nlibrary L { }\ncontract Bank is Base {\n  struct Acc { uint n; }\n  enum S { On }\n  modifier only() { check(); _; }\n  function pay(uint n) public only {\n    token.send(n);\n  }\n}\n',
        [("interface_declaration", "I", 3, 3), ("library_declaration", "L", 4, 4), ("contract_declaration", "Bank", 5, 12), ("struct_declaration", "Acc", 6, 6), ("enum_declaration", "S", 7, 7), ("modifier_definition", "only", 8, 8), ("function_definition", "pay", 9, 11)], [("check", 8), ("send", 10)], [("./Base.sol", None, False), ("./A.sol", None, False)]),
    "kotlin": ("import a.b.Helper\nimport a.c.*\nclass Cat(val n: Int) {\n  fun meow(): String {\n    return \"fun x()\"\n  }\n}\nfun <T> List<T>.top(): T = first()\ninterface Pet\n",
        [("class_declaration", "Cat", 3, 7), ("function_declaration", "meow", 4, 6), ("function_declaration", "top", 8, 8), ("class_declaration", "Pet", 9, 9)], [], [("a.b.Helper", "Helper", False), ("a.c.*", None, True)]),
    "powershell": ('. .\\tools.ps1\nImport-Module ./Net.psm1\nImport-Module Remote\n<# function Decoy {} #>\nfunction Get-Thing {\n  Write-Host "x"\n  if ($a) { Stop-It }\n}\nclass Disk {\n  [int] Size() { return 1 }\n}\n',
        [("function_statement", "Get-Thing", 5, 8), ("class_statement", "Disk", 9, 11), ("class_method_definition", "Size", 10, 10)], [("Import-Module", 2), ("Import-Module", 3), ("Write-Host", 6), ("Stop-It", 7)], [(".\\tools.ps1", None, True), ("./Net.psm1", None, False)]),
    "haskell": ("import Data.List\nimport qualified Data.Map as M\nimport Data.Set (member, Set(..))\nimport Data.Text hiding (map)\ndata Tree a = Leaf\n  | Node a\nclass Shape s where\n  area :: s -> Int\ndouble x = mul x\n  where mul = 2\n-- decoy y = z\nmain = go (double 3)\n",
        [("data_type", "Tree", 5, 6), ("class", "Shape", 7, 8), ("function", "double", 9, 10)], [("mul", 9), ("go", 12), ("double", 12)], [("Data.List.*", None, True), ("Data.Map", None, False), ("Data.Set", "member", False), ("Data.Set", "Set", False), ("Data.Text.*", None, True)]),
    "dart": ("import 'dart:core';\nimport './util.dart';\nclass Dog {\n  void bark(int n) {\n    say('fake()');\n  }\n}\nint twice(int x) {\n  return add(x, x);\n}\n",
        [("class_declaration", "Dog", 3, 7), ("method_declaration", "bark", 4, 6), ("function_declaration", "twice", 8, 10)], [("say", 5), ("add", 9)], [("./util.dart", None, False)]),
    "zig": ('const std = @import("std");\nconst P = struct {\n    x: i32,\n};\npub fn main() void {\n    std.debug.print("f()", .{});\n    step(1);\n}\n', [("variable_declaration", "P", 2, 4), ("function_declaration", "main", 5, 8)], [("print", 6), ("step", 7)], [("std", None, False)]),
    "julia": ('using Base\nimport Core\nusing Stats: mean, var\nstruct P\n  x\nend\nfunction area(p)\n  if p.x > 0\n    mul(p.x)\n  end\nend\nmacro twice(e)\n  quote e end\nend\n',
        [("struct_definition", "P", 4, 6), ("function_definition", "area", 7, 11), ("macro_definition", "twice", 12, 14)], [("area", 7), ("mul", 9), ("twice", 12)], [("Base.*", None, True), ("Core", None, False), ("Stats", "mean", False), ("Stats", "var", False)]),
    "groovy": ("import a.b.Tool\nclass Job {\n  def run(x) {\n    log(x)\n  }\n}\ndef helper(y) {\n  'fake()'\n}\n", [("class_declaration", "Job", 2, 6), ("method_declaration", "run", 3, 5), ("function_definition", "helper", 7, 9)], [("log", 4)], [("a.b.Tool", "Tool", False)]),
    "graphql": ("# import X from './base.graphql'\ninterface Node {\n  id: ID!\n}\ntype User {\n  posts(n: Int): Int\n}\ninput Filter {\n  q: String\n}\n",
        [("interface_type_definition", "Node", 2, 4), ("field_definition", "id", 3, 3), ("object_type_definition", "User", 5, 7), ("field_definition", "posts", 6, 6), ("input_object_type_definition", "Filter", 8, 10), ("field_definition", "q", 9, 9)], [], [("./base.graphql", None, False)]),
    "d": ("import std.stdio;\nimport std.algorithm : map, sum;\nstatic import std.conv;\nimport io = std.file;\nstruct P { int x; }\nclass C {\n}\nint add(int a) {\n  /+ fake() +/\n  return mul(a);\n}\n",
        [("struct_declaration", "P", 5, 5), ("class_declaration", "C", 6, 7), ("function_declaration", "add", 8, 11)], [("mul", 10)], [("std.stdio.*", None, True), ("std.algorithm", "map", False), ("std.algorithm", "sum", False), ("std.conv", None, False), ("std.file", None, False)]),
    "asm": ('.include "mac.inc"\nmain:\n  mov eax, 1 ; call decoy\n  call print_it\n  jne .loop\n.loop:\n  ret\n', [("label", "main", 2, 2), ("label", ".loop", 6, 6)], [("print_it", 4), (".loop", 5)], [("mac.inc", None, False)]),
    "elixir": ('defmodule Shop.Cart do\n  alias Shop.Item\n  use GenServer\n  def total(x) do\n    if x do\n      sum(x)\n    end\n  end\n  defp one, do: 1\n  def two do\n    IO.puts "end"\n  end\nend\n',
        [("call", "Shop.Cart", 1, 13), ("call", "total", 4, 8), ("call", "one", 9, 9), ("call", "two", 10, 12)], [("total", 4), ("sum", 6), ("puts", 11)], [("Shop.Item.*", None, True), ("GenServer.*", None, True)]),
    "scala": ('import a.b.Helper\nimport a.c._\nimport a.d.{X, Y}\ntrait T {\n  def need(x: Int): Int\n}\nobject App {\n  def run(x: Int): Int = {\n    go(x)\n  }\n}\nclass K(n: Int)\n',
        [("trait_definition", "T", 4, 6), ("function_declaration", "need", 5, 5), ("object_definition", "App", 7, 11), ("function_definition", "run", 8, 10), ("class_definition", "K", 12, 12)], [("go", 9)], [("a.b.Helper", "Helper", False), ("a.c._", None, True), ("a.d._", None, True)]),
    "swift": ('import Foundation\nstruct P {\n  func len() -> Int {\n    return measure(self)\n  }\n}\nfunc top() { p.draw() }\n', [("class_declaration", "P", 2, 6), ("function_declaration", "len", 3, 5), ("function_declaration", "top", 7, 7)], [("measure", 4), ("draw", 7)], [("Foundation.*", None, True)]),
    "perl": ("package My::Util;\nuse strict;\nuse Data::Dumper;\nuse List::Util qw(sum max);\nsub total {\n  my $x = sum(@_);\n  return $self->add($x); # fake()\n}\n", [("package_statement", "Util", 1, 1), ("function_definition", "total", 5, 8)], [("sum", 6), ("add", 7)], [("Data::Dumper.*", None, True), ("List::Util", "sum", False), ("List::Util", "max", False)]),
    "r": ('source("util.R")\narea <- function(w, h = f(1)) {\n  mul(w, h) # fake()\n}\n', [("binary_operator", "area", 2, 4)], [("source", 1), ("f", 2), ("mul", 3)], [("util.R", None, False)]),
    "ocaml": ("open List\nmodule M = struct\n  let one x = add x 1\nend\ntype t = A | B\nlet rec go n =\n  (* let decoy = 1 *)\n  print \"x\";\n  M.one n\n", [("module_binding", "M", 2, 4), ("let_binding", "one", 3, 3), ("type_binding", "t", 5, 5), ("let_binding", "go", 6, 9)], [("add", 3), ("print", 8), ("one", 9)], [("List.*", None, True)]),
    "elm": ("import Html\nimport Html.Attributes exposing (class, id)\nimport Html.Events exposing (..)\ntype alias Model =\n    { n : Int }\nview model =\n    div [] (text model)\n", [("type_alias_declaration", "Model", 4, 5), ("value_declaration", "view", 6, 7)], [("div", 7), ("text", 7)], [("Html", None, False), ("Html.Attributes", "class", False), ("Html.Attributes", "id", False), ("Html.Events.*", None, True)]),
    "nim": ('import strutils, pkg/util as u\nfrom seqs import map\ninclude "extra"\nproc area(w: int): int =\n  let x = mul(w)\n  return x\n\nfunc one(): int = 1\n', [("proc_declaration", "area", 4, 6), ("func_declaration", "one", 8, 8)], [("mul", 5)], [("strutils", None, False), ("pkg/util", None, False), ("seqs", "map", False), ("extra", None, False)]),
    "erlang": ('-module(shop).\n-include("shop.hrl").\n-include_lib("kernel/x.hrl").\ntotal([]) -> 0;\ntotal(L) ->\n  lists:sum(L) + tax(L).\n% fake() -> 1.\n', [("module_attribute", "shop", 1, 1), ("function_clause", "total", 4, 4), ("function_clause", "total", 5, 6)], [("tax", 6)], [("shop.hrl", None, False)]),
    "vim": ('source ~/util.vim\nfunction! s:Go(x)\n  " fake()\n  if a:x\n    call Step(a:x)\n  endif\nendfunction\n', [("function_definition", "s:Go", 2, 7)], [("Step", 5)], [("~/util.vim", None, False)]),
    "nix": ("let\n  lib = import ./lib.nix;\n  mk = { name, n ? 1 }: build name {\n    a = 1;\n  };\nin mk { name = \"x\"; }\n", [("binding", "mk", 3, 5)], [("import", 2), ("build", 3), ("mk", 6)], [("./lib.nix", None, False)]),
    "hcl": ('resource "aws_x" "web" {\n  name = upper("a")\n}\nmodule "net" {\n  source = "./net"\n}\nmodule "far" {\n  source = "reg/x"\n}\n', [("block", "aws_x", 1, 3), ("block", "net", 4, 6), ("block", "far", 7, 9)], [("upper", 2)], [("./net", None, True)]),
    "cmake": ("include(cmake/util.cmake)\nADD_SUBDIRECTORY(src)\nfunction(add_all name)\n  message(STATUS \"f()\")\nendfunction()\nmacro(m x)\nendmacro()\n# fake(x)\nadd_all(y)\n", [("function_def", "add_all", 3, 5), ("macro_def", "m", 6, 7)], [("include", 1), ("ADD_SUBDIRECTORY", 2), ("message", 4), ("add_all", 9)], [("cmake/util.cmake", None, False), ("src", None, False)]),
    "verilog": ('`include "defs.vh"\nmodule top(\n  input a\n);\n  function [3:0] inc;\n    input x;\n    inc = add(x);\n  endfunction\n  initial $display("f()");\nendmodule\n', [("module_header", "top", 2, 4), ("function_declaration", "inc", 5, 8)], [("add", 7)], [("defs.vh", None, False)]),
    "vhdl": ("library ieee;\nuse ieee.std.all;\nuse work.my_pkg.all;\nentity alu is\n  port (a : in bit);\nend entity;\narchitecture rtl of alu is\nbegin\n  process (a)\n  begin\n    if a then\n      log(a);\n    end if;\n  end process;\nend rtl;\n", [("entity_declaration", "alu", 4, 6), ("architecture_definition", "rtl", 7, 15)], [("log", 12)], [("my_pkg", None, True)]),
    "fortran": ("module shapes\n  use consts\n  use io, only: put, get\n  include 'x.inc'\ncontains\n  function area(w) result(a)\n    a = mul(w)\n  end function\n  subroutine show(a)\n    call put(a) ! call fake(a)\n  end subroutine show\nend module\n", [("module", "shapes", 1, 12), ("function", "area", 6, 8), ("subroutine", "show", 9, 11)], [("mul", 7), ("put", 10)], [("consts.*", None, True), ("io", "put", False), ("io", "get", False), ("x.inc", None, False)]),
    "prolog": (":- use_module('util.pl').\n:- [facts].\n:- use_module(library(lists)).\nparent(tom, bob).\ngrand(X, Z) :-\n  parent(X, Y),\n  parent(Y, Z). % fake(x)\n", [("clause", "parent", 4, 4), ("clause", "grand", 5, 7)], [("use_module", 1), ("use_module", 3), ("library", 3), ("parent", 4), ("grand", 5), ("parent", 6), ("parent", 7)], [("util.pl", None, False), ("facts", None, False)]),
    "racket": ('(require "util.rkt")\n(require racket/base)\n(struct point (x y))\n(define (area w)\n  ; (fake)\n  (mul w "(f)"))\n', [("list", "point", 3, 3), ("list", "area", 4, 6)], [("x", 3), ("area", 4), ("mul", 6)], [("util.rkt", None, False)]),
    "scheme": ('(include "util.scm")\n(define one 1)\n(define (area w)\n  (if w (mul w 2) 0))\n', [("list", "one", 2, 2), ("list", "area", 3, 4)], [("include", 1), ("area", 3), ("mul", 4)], [("util.scm", None, False)]),
    "proto": ('import "base.proto";\nmessage User {\n  string name = 1;\n}\nservice Api {\n  rpc Get(User) returns (User);\n}\n', [("message", "User", 2, 4), ("service", "Api", 5, 7), ("rpc", "Get", 6, 6)], [], [("base.proto", None, False)]),
    "ada": ('with Ada.Text_IO, My.Util;\npackage body Shop is\n   procedure Show (X : Integer) is\n   begin\n      if X > 0 then\n         Put_Line ("end");\n      end if;\n   end Show;\n   function Sum (A : Integer) return Integer;\nend Shop;\n', [("package_body", "Shop", 2, 10), ("subprogram_body", "Show", 3, 8), ("subprogram_declaration", "Sum", 9, 9)], [("Put_Line", 6)], [("Ada.Text_IO", None, True), ("My.Util", None, True)]),
    "wgsl": ("#import bevy::mesh\nstruct Out {\n  a: f32,\n}\nfn shade(x: f32) -> f32 {\n  return x;\n}\n", [("struct_declaration", "Out", 2, 4), ("function_declaration", "shade", 5, 7)], [], [("bevy::mesh", None, True)]),
    "latex": ("\\section{Intro}\n\\label{sec:in}\n% \\input{decoy}\n\\input{chapters/one}\n", [("section", "Intro", 1, 1), ("label_definition", "sec:in", 2, 2)], [], [("chapters/one", None, False)]),
    "svelte": ("<p>import x from 'no'</p>\n<script lang=\"ts\">\n  import { on } from './store';\n  const x = 1;\n</script>\n", [], [], [("./store", "on", False)]),
    "vue": ("<template/>\n<script>\nimport App from './App';\n</script>\n<script lang='ts'>import './b'</script>\n", [], [], [("./App", None, False), ("./b", None, False)]),
}
