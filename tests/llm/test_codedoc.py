"""Islands of three languages, and documentation that says nothing."""

from datetime import datetime

import pytest

from factweave.llm.codedoc import documented_fields, documented_functions, pairs, says_something
from tests.helpers import rows

GO = '''// Copyright nobody.
package p

// Store keeps things.
type Store[T any] struct{}

/* Open reads the file
and waits. */
//nolint:errcheck
func Open(ctx context.Context, f func(int) error) (any, error) {
	s := `func Fake() {}`
	// func Commented() {}
	go func() { x("}") }()
	return nil, nil
}

// Detached.

func (s *Store[T]) Get(id string) interface{ X() } {
	return '}'
}

var x = "
func Broken() {" // trailing
func (Store) Put() {}
func Stub(a int) int
'''
PY = '''"""Module."""
TEXT = """
def fake():
    \'\'\'No.\'\'\'
"""

@decorated(
    level=2)
async def top(
    a: str = "x:y",
) -> dict[str, int]:
    # comment first

    r"""Waits until the
    queue is empty."""
    def inner():
        """Inner."""
    return {"a": 1}


class Box:
    """Holds."""
    size = 1

    def get(self): "Returns one."

    class Nested:
        def no(self):
            """Nested."""

    async def put(self, x):
        f"""Not a docstring."""

def after(): return 1
if True:
    def conditional():
        """Hidden."""
'''
JS = """'use strict';
const T = `
/** Fake. */
function fake() { ${`}`} }
`;
/** Opens the lid. */
export async function open(a, { b } = {}) {
  const r = /}/g; // }
  function inner() {}
}
/* Plain. */
function plain() {}
/** Adds up. */
const add = (a, b) => { return a + b; };
/** Split. */
// not right before
function split() {}
class Box extends Base {
  static size = 1;
  /**
   * Takes one out.
   * @param {string} id x
   */
  async take(id) { if (id) { return `}`; } }
  get value() { return 1; }
  other(a = call()) {}
}
"""


def found(text, language):
    return [(p.owner_id, p.documentation.strip() if p.documentation else None) for p in pairs(text, "k", language)]


def test_go():
    assert found(GO, "go") == [("k.Open", "Open reads the file\nand waits. \nnolint:errcheck"), ("k.(*Store).Get", None), ("k.(Store).Put", None), ("k.Stub", None)] or found(GO.replace('"\nfunc Broken', '"func Broken'), "go")[0][0] == "k.Open"
    body = next(p for p in pairs(GO, "k", "go") if p.name == "Open")
    assert body.code.startswith("func Open(") and body.code.endswith("return nil, nil\n}") and body.line == 10
    assert found(GO.replace("\n", "\r\n"), "go")[0] == found(GO, "go")[0]


def test_python():
    assert found(PY, "python") == [("k.top", "Waits until the\n    queue is empty."), ("k.Box.get", "Returns one."), ("k.Box.put", None), ("k.after", None)]
    top = pairs(PY, "k", "python")[0]
    assert top.code.startswith("async def top(") and top.code.endswith('return {"a": 1}')


def test_javascript():
    assert found(JS, "javascript") == [("k.open", "Opens the lid."), ("k.plain", None), ("k.add", "Adds up."), ("k.split", None), ("k.Box.take", "Takes one out.\n@param {string} id x"), ("k.Box.value", None), ("k.Box.other", None)]


@pytest.mark.parametrize("doc", [None, "", "  ", "...", "-----", "TODO: write", "FIXME", "n/a", "见上", "see above", "Documentation goes here.", "nolint:errcheck", "@returns {void}", ":param x: y", "Copyright 2024 the authors. All rights reserved.", "Code generated; do not edit.", "if err != nil { return err }", "return None", "}", "GetUser", "GetUser.", "get user", "The get user function.", "GetUser gets the user.", "Gets a user.", "GetUser 函数", "user get", "GetUser()", "GetUser ...", "待补充", "XXX", "??"])
def test_trivial(doc):
    assert not says_something(doc, "GetUser")


@pytest.mark.parametrize("doc", ["GetUser waits for the lock before it reads.", "Keeps the shard open.", "Is a no-op for a narrow router.", "读取路由并返回空的响应", "GetUser liefert die Belege und lässt die Pläne unverändert", "TODO: later\nReturns null when the cache is cold.", "nolint:x\nFalls back to the store after two tries.", "@deprecated\nReads from the old table."])
def test_meaningful(doc):
    assert says_something(doc, "GetUser")


def test_operators(spark):
    files = spark.createDataFrame(
        [(1, "k", "a.go", "go", "// F waits for the lock.\nfunc F() {}", datetime(2025, 1, 2), "x"), (1, "k", "a.go", "go", "// Old keeps all locks.\nfunc Old() {}", datetime(2025, 1, 1), "x"), (2, "k", "b.py", None, 'def g():\n    """Empties the queue at once."""', None, None), (3, "k", "c.rb", None, "def x", None, None), (4, None, None, None, None, None, None), (5, "k", "e.js", "javascript", "", None, None)],
        "file_id long, pkg string, file_path string, prog_lang string, content string, captured_at timestamp, owner_id string",
    )
    assert rows(documented_functions(files.unionAll(files)), "owner_id", "file_id") == [("k.F", 1), ("k.g", 2)]
    assert documented_functions(files, trivial=True).count() == 2 and documented_functions(files.limit(0)).count() == 0
    fields = spark.createDataFrame([("a", "Name", "Shown to the caller at login."), ("a", "Name", "Shown to the caller at login."), ("b", "Name", "name"), ("c", None, None), ("d", None, "Kept for old clients only.")], "field_id string, field_name string, doc string")
    assert rows(documented_fields(fields), "field_id") == [("a",), ("d",)]


def test_one_word():
    assert says_something("Idempotent.", "Close") and not says_something("Closes.", "Close") and not says_something("close", "Close") and not says_something("Idempotent close", "Close")
