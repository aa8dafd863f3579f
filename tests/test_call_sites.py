from assize.operators import documents, hydration

RUST = """use x;
static A: u8 = init();
impl<T> B<T> {
    fn own(&self, s: &str) -> [u8; 2] where T: C {
        let t = "}"; // }
        let c = |x| helper(x);
        fn inner() { deep() }
        done('}')
    }
}
trait D { fn only(&self); }
"""
PYTHON = """top()
class A:
    def _own(
        self,
    ):
        text = '''
dedented }
'''
        one(text)

        def nested():
            two()
        three()

    async def last(self): four()
end()
"""
TS = """start();
class A {
  private async load(a: { b: string }): Promise<{ c: number }> {
    if (a) { first(`}${a.b}`); }
  }
  get size(): number { return second(); }
}
function hidden<T>(x: T): { y: T } {
  const f = () => { third(); };
}
describe("x", () => { fourth(); });
"""
GO = """func (r *T) own(a interface{}) (int, error) {
	one("}")
}
func Two() map[string]struct{} {
	two()
}
"""


def callers(spark):
    rows = [("r", "rust", RUST), ("p", "python", PYTHON), ("t", "typescript", TS), ("g", "go", GO), ("n", "go", None), ("e", "rust", "")]
    files = spark.createDataFrame(rows, "path string, lang string, text string")
    return {(r["path"], r["callee"], r["caller"]) for r in hydration.callers(documents.calls(files), documents.definitions(files), outside=True).collect()}


def test_calls_in_private_and_nested_functions_and_outside_any(spark):
    assert callers(spark) == {
        ("r", "init", None), ("r", "helper", "own"), ("r", "deep", "inner"), ("r", "done", "own"),
        ("p", "top", None), ("p", "one", "_own"), ("p", "two", "nested"), ("p", "three", "_own"), ("p", "four", "last"), ("p", "end", None),
        ("t", "start", None), ("t", "first", "load"), ("t", "second", "size"), ("t", "third", "hidden"), ("t", "describe", None), ("t", "fourth", None),
        ("g", "one", "own"), ("g", "two", "Two"),
    }


def test_function_that_is_cut_off_ends_with_its_indentation():
    spans, _ = documents.functions("rust", "fn a() {\n    b(\n}\nfn c() {\n    d();\n")
    assert spans == [("a", 1, 3), ("c", 4, 5)]
