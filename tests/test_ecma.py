"""The parser on forms that are easily read wrongly, and the scanner's rules on scopes and aliases."""

import pytest

from lockgrain.sources import jsscan
from lockgrain.sources.ecma import SourceError, parse

GOOD = """a=1
const {a,b:c=2,...d}=x; let [e,,f]=y
(a,b)=>a+b
async (x)=>{await x}
async()
x = {a,b:1,get c(){return 1},async *d(){},[e]:2,'f':3, async, get, set}
class A extends B{static #p=1; static{this.x=1} get a(){return 1} async *b(){} 'c'(){} [d]=1; static async e(){} get; set; static; async}
for(const x of y){} for(let i=0,j=1;i<2;i++);for(a in b);for(var z in q);for(x.y of z);
`a${b}c${`n${d}`}`
x=/ab+c[/]/g.test(y)/2
try{}catch{}finally{}
import a,{b as c,default as d} from 'x'; export default function(){}
export * as q from 'x'; export {a as b, c}; export const z=1
new a.b.c(1).d()
a?.b?.[c]?.(d)
({a=1}={})
({a=1})=>a
[a,b]=[b,a]
#!/usr/bin/env node
do x(); while(y) z
function* g(){yield; yield* a; yield b}
if(1){}/a/g
x={}/1
with(a){}
x = y => z => w
a = b ? (c) : d => e
(async()=>{for await(const x of y);})()
x?.5:1
a.class.default.if
of=1; for(of of of);
import.meta.url
await x
0777
((a))=1""".split("\n")
BAD = ["a b", "(a,b", "{", "}", "return 1", "var", "a=", "'x", "/a", "`a", "(a,)", "()", "({a=1})", "f(({a=1}))", "1a", "import x", "class{", "a?b", "for(;;", "const a;", "1=2", "a++ ++", "x=>{}=1", "]", "/*", "throw\na", "function(){}", "export x", "({get a:1})", "new import('x')", "let a = ;"]


@pytest.mark.parametrize("source", GOOD)
def test_source_is_read(source):
    assert parse(source).type == "Program"


def test_lines_break_statements():
    for source in ("a=b\n/c/d", "x\n++y", "async\nfunction f(){}", "()=>{}\n/a/.test(b)", "let\nx"):
        parse(source)


@pytest.mark.parametrize("source", BAD)
def test_source_is_refused(source):
    with pytest.raises(SourceError):
        parse(source)


def test_modules_and_scripts_differ():
    with pytest.raises(SourceError):
        parse("with(a){}", "module")
    with pytest.raises(SourceError):
        parse("import 'x'", "script")
    with pytest.raises(SourceError, match="too long"):
        parse("a;" * 100_000, "script", 1e-9)


def found(source, **options):
    return [(k, line) for k, line, _ in jsscan.detect(source, **options)]


def test_aliases_and_shadows():
    assert found("const read = fs.readFile;\nconst fs = require('fs');\nread('i', () => {});\n{ const process = { env: {} }; process.env.LOCAL; }\nfunction outer(fetch) { function inner() { fetch('local'); } inner(); }") == [("FS_READ", 3)]
    assert found("const fs = require('fs');\nconst read = fs.readFile;\nconst again = read;\nagain('x');\n") == [("UNKNOWN", 4)]
    assert found("const fs = require('fs');\nfs.watch('x');\nfs[name]('x');\nfs.promises.readFile('x');") == [("UNKNOWN", 4)]
    assert found("const fs = require('fs');\nconst path = require('path');\nfs.readFileSync(path.join(home, '.ssh', 'id_rsa'));\nfs.writeFileSync('.env.production', 'x');\nfs.readFileSync('.env.example');\nfs.readFileSync(`.npmrc`);") == [("FS_READ", 3), ("FS_READ", 5), ("FS_READ", 6), ("FS_SENSITIVE", 3), ("FS_SENSITIVE", 4), ("FS_SENSITIVE", 6), ("FS_WRITE", 4)]
    assert found("import * as fs from 'node:fs';\nimport { unlink as remove } from 'fs';\nfs.writeFileSync('o');\nremove('x');") == [("FS_WRITE", 3), ("FS_WRITE", 4)]
    assert found("require('child' + '_process').exec('x');") == [("UNKNOWN", 1)]
    assert found("WebAssembly.compile; process.dlopen; new WebAssembly.Module(b)") == [("NATIVE", 1)]
    assert found("Function('x'); window.eval('y'); o.fetch()") == []


def test_snippets_are_bounded():
    [(_, _, snippet)] = jsscan.detect("   " + "/*" + "x" * 300 + "*/ eval('1')")
    assert len(snippet) == 240 and snippet.startswith("/*x")
