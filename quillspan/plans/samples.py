"""A small corpus for queries whose semantics are about code, as rows and as SQL."""

from __future__ import annotations

ROOT = "/app"
FILES = [
    ("/app/src/main.ts", "import { load } from './store';\nimport { fmt } from './util/format';\nimport * as cfg from '../config.js';\n\nexport function main(argv: string[]): number {\n  if (argv.length > 2 && cfg.on) {\n    return load(argv[2]) ? 0 : 1;\n  } else if (argv.length === 1) {\n    for (const a of argv) {\n      fmt(a);\n    }\n  }\n  return 2;\n}\n"),
    ("/app/src/store.ts", "import { fmt } from './util/format';\nimport type { Item } from './model';\nimport { unused } from './lost';\n\nexport class Store {\n  items: Item[] = [];\n  add(x: Item) {\n    this.items.push(x);\n  }\n}\nexport const load = (key: string) => {\n  try {\n    return fmt(key);\n  } catch (e) {\n    return null;\n  }\n};\n"),
    ("/app/src/model.ts", "import { Store } from './store';\nexport interface Item {\n  id: number;\n  owner: Store;\n}\nexport type Key = string | number;\n"),
    ("/app/src/util/format.ts", "export function fmt(x: string) {\n  return x ? x.trim() : '';\n}\nexport const WIDE = 80;\nfunction _hidden() {}\n"),
    ("/app/src/lost.tsx", "import React from 'react';\nexport const unused = 1;\nexport default function Page() {\n  return null;\n}\n"),
    ("/app/src/orphan.js", "import { a } from './missing';\nconst b = require('./store');\nexport function alone() { while (b) { a(); } }\n"),
    ("/app/config.ts", "export const on = true;\n"),
    ("/app/tests/main.test.ts", "import { main } from '../src/main';\nif (main([]) !== 2) throw new Error('FAIL');\n"),
    ("/app/tools/run.py", "import os, sys\nfrom typing import List\nimport json as j\n\nclass Runner:\n    def __init__(self):\n        self.x = 1\n\n    async def _go(self, n: int) -> List[int]:\n        for i in range(n):\n            if i % 2:\n                yield i\n\ndef run(argv):\n    try:\n        return Runner()\n    except ValueError:\n        return None\n"),
    ("/app/tools/serve.go", "package main\n\nimport (\n\t\"fmt\"\n\t\"net/http\"\n)\n\ntype Server struct {\n\tport int\n}\n\nfunc NewServer(p int) *Server {\n\treturn &Server{port: p}\n}\n\nfunc (s *Server) Run() {\n\tfmt.Println(s.port)\n}\n\nfunc helper(x int) int {\n\tif x > 0 {\n\t\treturn x\n\t}\n\treturn -x\n}\n"),
    ("/app/README.md", "# Not code\n"),
]
LOGS = [
    ("lint", 1, "/app/src/a.ts:3:10  error  Unexpected any"), ("lint", 2, "/app/src/b.ts:14:1  warning  Missing return"), ("lint", 3, "2 problems"),
    ("typescript", 1, "src/a.ts(3,10): error TS2304: Cannot find name 'x'."), ("typescript", 2, "Found 1 error."),
    ("test", 1, "PASS src/a.test.ts"), ("test", 2, "FAIL src/b.test.ts"), ("test", 3, "  Error: expected 1"),
]
COVERAGE = '{"total":{"lines":{"pct":50}},"src/a.ts":{"statementMap":{"0":{"start":{"line":3}},"1":{"start":{"line":9}},"2":{"start":{"line":12}}},"s":{"0":4,"1":0,"2":0}},"src/b.ts":{"statementMap":{"0":{"start":{"line":1}}},"s":{"0":1}},"src/c.ts":{"statementMap":{},"s":{}}}'
NAMES = [(1, ["a", "b", "console", "total"], ["total"]), (2, ["x", "x", "Math"], []), (3, [], ["z"]), (4, ["JSON", "y", "q"], ["q"])]
PATHS = ["/app/src/../lib/./a.ts", "/a//b/../../c", "./x/../y", "../../z/w", "/..", "a/b/c/../..", ""]
FOLDERS = [("/app/src", "/app/src/T.types.ts"), ("/app/src", "/app/src/deep/er/T.types.ts"), ("/app/src/a", "/app/src/T.types.ts"), ("/app/src/a/b", "/app/lib/T.types.ts")]


def quoted(x) -> str:
    """A SQL literal that both engines read alike."""
    if x is None:
        return "NULL"
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "CAST([" + ", ".join(map(quoted, x)) + "] AS VARCHAR[])"
    return "'" + x.replace("'", "''") + "'"


def values(rows: list, columns: str) -> str:
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS v({columns}))"
TABLE = ["File | % Stmts | % Branch | % Funcs | % Lines", "src/a.ts | 85.5 | 80 | 90 | 85.5 | 10-15", "src/b.ts  |  100 | 100 | 100 | 100 |", "done"]
REPLIES = [
    (1, 'Sure:\n```json\n{"suggestions": [{"title": "Split", "type": "structure", "priority": "high", "riskScore": 15, "startLine": 3, "endLine": 9, "autoApplicable": true}, {"description": "Name it", "riskScore": 0}, {"title": "", "riskScore": 79.5, "reasoning": "long"}]}\n```\nDone.'),
    (2, '{"suggestions": [{"type": "naming", "riskScore": 80}, {"riskScore": 20}, {"riskScore": 50}, {}, {"title": "e"}, {"title": "sixth"}]}'),
    (3, '[{"title": "a bare array"}]'), (4, "no JSON at all"), (5, '{"suggestions": {"title": "no array"}}'), (6, '{"suggestions": [null]}'), (7, '{"suggestions": []}'), (8, '{"other": 1}'), (9, ""),
]
CHANGES = [("/app/config.ts", "update", "export const on = false;\n"), ("/app/src/new.ts", "create", "a\nb"), ("/app/README.md", "delete", None), ("/app/none.ts", "delete", None)]
TYPE_PATHS = [("/a/x.types.ts", True), ("/a/x.types.tsx", True), ("/a/x.d.ts", True), ("/a/types.ts", True), ("types.tsx", True), ("/a/index.types.ts", True), ("/a/mytypes.ts", False), ("/a/types/x.ts", False), ("/a/x.d.tsx", False)]


def _large(n: int) -> list[tuple[str, str]]:
    """Files above each threshold: long ones, functions that are long or branch much, at both severities."""
    out = []
    for k in range(n):
        lines = []
        for j, (length, branches) in enumerate([(20 + 15 * k, 2), (30, 4 * k), (8, 1)]):
            body = [f"  if (x > {i}) {{ x += {i}; }}" for i in range(branches)]
            body += [f"  x = x + {i};" for i in range(max(length - len(body) - 2, 0))]
            lines += [f"{'export ' if j % 2 == 0 else ''}function part{j}(x: number) {{", *body, "}", ""]
        lines += [f"export const value{i} = {i};" for i in range(60 * k)]
        out.append((f"/app/big/file{k}.ts", "\n".join(lines)))
    return out


LARGE = _large(10)
TYPED = [
    ("/app/shop/order.ts", "import { pay } from './pay';\nimport { log } from '../log';\n\nexport interface Order {\n  id: number;\n  lines: Line[];\n  state: State;\n}\ninterface Line {\n  part: Part;\n}\nexport type State = 'open' | 'paid';\nexport function close(o: Order) {\n  pay(o);\n  log(o);\n}\n"),
    ("/app/shop/part.ts", "export const NONE = 0;\nexport type Part = { weight: number; kind: Kind };\nexport interface Kind {\n  name: string;\n}\n"),
    ("/app/shop/plain.ts", "export const one = 1;\nexport const two = 2;\nexport const three = 3;\n"),
    ("/app/shop/own.types.ts", "export interface Own {\n  x: number;\n}\n"),
]
