"""Source text as nested spans: classes, routes, suites, cases and claims of files as people write them."""

import pytest

from impactloom.sources import spans, specs

SERVICE = r"""
import { Controller, Get } from '@nestjs/common';
// class Ghost { m() {} }
/* @Controller() class Ghost2 { x() {} } */
const s = "class Fake { y() {} }", t = `class ${`Fake${1}`} { z() { if (a) {} } }`;
@Controller({ path: 'users', version: '1' })
@UseGuards(AuthGuard)
export class UsersController<T extends { a: string }> extends Base<{ q: number }> implements A, B {
  private readonly cache = new Map<string, { a: number }>();
  @Input() name: string
  constructor(private readonly users: UsersService, @Inject('X') x = { a: 1 }) { super(); }
  @Get(":id")
  @Roles('admin', "x)")
  async find<K>(@Param('id') id: string, @Query() { a, b }: { a: string; b: Map<string, number> } = { a: '', b }, ...rest: string[]): Promise<{ ok: boolean }> {
    if (id && /a)\)[)]/.test(id)) { throw new NotFoundException("no ) id") }
    switch (id) { case 'a': return 1; case 'b': { return 2 } default: break; }
    try { await this.users.find(id) } catch (e) { throw e; }
    return { ok: true };
  }
  @Post(`bulk`) bulk(): void {}
  @Delete('a' + b) gone(x?: number, y = 2) { return x ? y : { if: 1 } }
  private helper() { return 1 }
  handler = async () => { if (1) {} };
  get value() { return 1 }
  overload(a: string): void;
  overload(a: any): { z: number } { return a }
}
@Entity() export class User { id: number; save() {} }
@Injectable()
class Svc { protected run(a, b?) { if (x) return
 if (y) throw new Error(`a ${b}`)
 } }
class Plain { no() {} }
"""

SPEC = r"""
import { build, Order as O } from '../order';
const repo = { find: jest.fn(), save: jest.fn() };
let mail: jest.Mocked<Mail>;
describe("Orders", () => {
  const service = new Service(repo);
  beforeEach(() => { repo.find.mockResolvedValue({ id: f(1) }); const seed = { a: 1 }; service.reset() });
  afterAll(done => done())
  beforeEach(setup);
  it(`adds "one"`, async () => {
    const input = { qty: 2, note: "it('no')" }
    const result = await service.add(input);
    expect(result).toEqual({ ok: true })
    expect(repo.find).toHaveBeenNthCalledWith(1, 'x');
    expect(f(g(h(i(j(1)))))).toBe(2);
    expect(")").toBe(1)
    mail.send.mockReturnValue(1); other.mockReturnValue(2);
    build(1); expect(x)['toBe'](1); expect(result.view).toMatchSnapshot()
  });
  describe.skip('later', function () { test("skipped", () => { expect(1).toBe(1) }); it.todo(`open`); test('third', () => {}) });
  describe('in', () => { test.only('deep', () => { expect(() => service.pay(0)).toThrow('no'); [1].forEach(x => { service.run(x) }); expect(order.total).toBe(expect.any(Number)) }) });
  it('twice', () => {}); it('twice', () => {});
  it.each([[1, 2], [3, 4]])('row %i', (a, b) => { expect(add(a, b)).toBeDefined() });
  it.each`a|b`('tag', () => {});
  if (x) { it('conditional', () => {}) }
  it(name, () => {});
  it('outer', () => { it('inner', () => {}) });
});
"""


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


@pytest.fixture(scope="module")
def found(spark):
    f = files(spark, ("a/u.ts", SERVICE), ("c/e.ts", ""), ("d/n.ts", None), ("x.spec.ts", "class X {}"), ("y.entity.ts", "export class Y { m() {} }"))
    return spans.artifacts(f).collect()


def test_classes_and_methods(found):
    got = {(r["path"], r["type"], r["symbol"], r["start_line"], r["end_line"], r["verb"], r["route"], r["return_type"]) for r in found}
    assert got == {
        ("a/u.ts", "API_ROUTE", "UsersController.find", 12, 19, "GET", ":id", "Promise<{ ok: boolean }>"),
        ("a/u.ts", "API_ROUTE", "UsersController.bulk", 20, 20, "POST", "bulk", "void"),
        ("a/u.ts", "API_ROUTE", "UsersController.gone", 21, 21, "DELETE", None, None),
        ("a/u.ts", "API_ROUTE", "UsersController.overload", 26, 26, None, None, "{ z: number }"),
        ("a/u.ts", "ENTITY", "User", 28, 28, None, None, None),
        ("a/u.ts", "SERVICE_METHOD", "Svc.run", 30, 32, None, None, None),
        ("y.entity.ts", "ENTITY", "Y", 1, 1, None, None, None),
    }


def test_parameters_and_branches(found):
    by = {r["symbol"]: r for r in found}
    assert [tuple(p) for p in by["UsersController.find"]["parameters"]] == [
        ("id", "string", "@Param('id') id: string"),
        ("{ a, b }", "{ a: string; b: Map<string, number> }", "@Query() { a, b }: { a: string; b: Map<string, number> } = { a: '', b }"),
        ("rest", "string[]", "...rest: string[]"),
    ]
    assert [(c["kind"], c["source_text"]) for c in by["UsersController.find"]["conditions"]] == [
        ("IF", r"id && /a)\)[)]/.test(id)"),
        ("SWITCH_CASE", "case 'a': return 1;"),
        ("SWITCH_CASE", "case 'b': { return 2 }"),
        ("SWITCH_DEFAULT", "default: break;"),
    ]
    assert [(c["kind"], c["source_text"]) for c in by["UsersController.find"]["handlers"]] == [
        ("THROW", 'throw new NotFoundException("no ) id")'),
        ("CATCH", "catch (e) { throw e; }"),
        ("THROW", "throw e;"),
    ]
    assert [(c["kind"], c["source_text"], c["line"]) for c in by["Svc.run"]["conditions"]] == [("IF", "x", 30), ("IF", "y", 31)]
    assert [tuple(p) for p in by["UsersController.gone"]["parameters"]] == [("x", "number", "x?: number"), ("y", "UNDECLARED", "y = 2")]
    assert len({r["signature"] for r in found if r["type"] != "ENTITY"}) == 5


def test_twenty_branches_and_parameters_are_kept(spark):
    body = " ".join(f"if (x{i}) {{ throw e{i} }}" for i in range(30))
    args = ", ".join(f"a{i}: A<B, {i}>" for i in range(25))
    r = spans.artifacts(files(spark, ("a.ts", f"@Injectable() class A {{ m({args}) {{ {body} }} }}"))).collect()[0]
    assert [c["source_text"] for c in r["conditions"]] == [f"x{i}" for i in range(20)] and len(r["handlers"]) == 20
    assert [p["name"] for p in r["parameters"]] == [f"a{i}" for i in range(20)]


def test_what_cannot_be_read_is_told(spark):
    toks = spans.tokens(files(spark, ("b.ts", "const a = 'open\nfoo(\n"), ("c.ts", "a(]"), ("ok.ts", "a(b[1], `${{}}`)"), ("n.ts", None)))
    assert {tuple(r) for r in spans.broken(toks).collect()} == {("b.ts", "UNTERMINATED_TEXT", 1), ("b.ts", "UNBALANCED_BRACKET", 1), ("c.ts", "UNBALANCED_BRACKET", 1)}


def test_places_cover_the_text(spark):
    f = files(spark, ("s.ts", SERVICE), ("t.ts", SPEC), ("u.ts", "  ä = 'ß\\'' // x\n/* 😀 */ b"))
    texts = {"s.ts": SERVICE, "t.ts": SPEC, "u.ts": "  ä = 'ß\\'' // x\n/* 😀 */ b"}
    for r in spans.lexed(f).collect():
        text = texts[r["path"]]
        assert text[r["start"] : r["end"]] == r["t"] and r["line"] == text[: r["start"]].count("\n") + 1


def test_long_literals_do_not_overflow(spark):
    text = "a(" + '"' + "x\\\"" * 30_000 + '", `' + "y\\`${z}" * 3_000 + "`, /* " + "* " * 50_000 + "*/ b)"
    assert [r["t"] for r in spans.lexed(files(spark, ("a.ts", text))).where("kind IN ('name', 'mark')").collect()] == ["a", "(", ",", ",", "b", ")"]


def test_cases_and_their_suites(spark):
    c, gaps = specs.cases(spans.tokens(files(spark, ("u.spec.ts", SPEC), ("e.spec.ts", ""), ("v.spec.ts", "test('a', () => expect(1).toBe(1)); it('b')"))))
    got = {(r["path"], tuple(r["suites"]), r["title"], r["modifier"], r["declared"], r["parameterized"]) for r in c.collect()}
    assert got == {
        ("u.spec.ts", ("Orders",), 'adds "one"', "NORMAL", "NORMAL", False),
        ("u.spec.ts", ("Orders", "later"), "skipped", "SKIP", "NORMAL", False),
        ("u.spec.ts", ("Orders", "later"), "open", "SKIP", "TODO", False),
        ("u.spec.ts", ("Orders", "later"), "third", "SKIP", "NORMAL", False),
        ("u.spec.ts", ("Orders", "in"), "deep", "ONLY", "ONLY", False),
        ("u.spec.ts", ("Orders",), "row %i", "NORMAL", "NORMAL", True),
        ("v.spec.ts", (), "a", "NORMAL", "NORMAL", False),
    }
    told = {tuple(r) for r in gaps.collect()}
    assert told == {("u.spec.ts", "JEST_UNSUPPORTED_DECLARATION", 5), ("u.spec.ts", "JEST_DUPLICATE_TEST_IDENTITY", 2), ("v.spec.ts", "JEST_UNSUPPORTED_DECLARATION", 1)}


def test_claims_and_what_they_relate_to(spark):
    found, gaps = specs.claims(files(spark, ("u.spec.ts", SPEC)))
    rows = found.collect()
    one = {(r["kind"], r["assertion_kind"], r["source_text"]) for r in rows if r["title"] == 'adds "one"'}
    assert one == {
        ("SETUP_HOOK", None, "beforeEach(() => { repo.find.mockResolvedValue({ id: f(1) }); const seed = { a: 1 }; service.reset() })"),
        ("TEARDOWN_HOOK", None, "afterAll(done => done())"),
        ("MOCK", None, "repo.find.mockResolvedValue({ id: f(1) })"),
        ("INPUT", None, "seed = { a: 1 }"),
        ("INPUT", None, "input = { qty: 2, note: \"it('no')\" }"),
        ("ACTION", None, "service.add(input)"),
        ("ASSERTION", "RETURN_VALUE", "expect(result).toEqual({ ok: true })"),
        ("EXPECTED_OUTCOME", "RETURN_VALUE", "{ ok: true }"),
        ("ASSERTION", "INVOCATION_ARGUMENTS", "expect(repo.find).toHaveBeenNthCalledWith(1, 'x')"),
        ("EXPECTED_OUTCOME", "CALL_COUNT", "1"),
        ("EXPECTED_OUTCOME", "INVOCATION_ARGUMENTS", "'x'"),
        ("ASSERTION", "RETURN_VALUE", "expect(f(g(h(i(j(1)))))).toBe(2)"),
        ("ACTION", None, "f(g(h(i(j(1)))))"),
        ("EXPECTED_OUTCOME", "RETURN_VALUE", "2"),
        ("ASSERTION", "RETURN_VALUE", 'expect(")").toBe(1)'),
        ("EXPECTED_OUTCOME", "RETURN_VALUE", "1"),
        ("MOCK", None, "mail.send.mockReturnValue(1)"),
        ("ASSERTION", None, "expect(result.view).toMatchSnapshot()"),
    }
    deep = {(r["kind"], r["source_text"]) for r in rows if r["title"] == "deep"}
    assert ("ACTION", "service.pay(0)") in deep and not any("run" in t for _, t in deep)
    assert ("INPUT", "[[1, 2], [3, 4]]") in {(r["kind"], r["source_text"]) for r in rows if r["title"] == "row %i"}
    assert not any(r["title"] in ("skipped", "open", "third") for r in rows)
    at = {(r["kind"], r["source_text"]): r for r in rows if r["title"] == 'adds "one"'}
    assertion, call, outcome = at["ASSERTION", "expect(result).toEqual({ ok: true })"], at["ACTION", "service.add(input)"], at["EXPECTED_OUTCOME", "{ ok: true }"]
    assert assertion["invocation_start"] == call["start"] and outcome["assertion_start"] == assertion["start"] and assertion["subject"] == "result"
    codes = {r["code"]: r["n"] for r in gaps.collect()}
    assert codes == {"ACTION_RECEIVER_UNRESOLVED": 1, "ASSERTION_INVOCATION_UNRESOLVED": 4, "DYNAMIC_MATCHER_NOT_ANALYZED": 1, "JEST_DUPLICATE_TEST_IDENTITY": 2, "JEST_UNSUPPORTED_DECLARATION": 5, "MOCK_IDENTITY_UNRESOLVED": 1, "NESTED_CALLBACK_NOT_ANALYZED": 1, "OUTCOME_NOT_EXPLICIT": 1, "SNAPSHOT_EXPECTATION_UNRESOLVED": 1, "UNSUPPORTED_SETUP_HOOK": 1}


def test_a_hundred_claims_a_case(spark):
    calls = "; ".join(f"run({i})" for i in range(130))
    found, gaps = specs.claims(files(spark, ("u.spec.ts", f"it('many', () => {{ {calls}; a('{'x' * 2001}') }})")))
    assert [r["source_text"] for r in found.orderBy("start").collect()] == [f"run({i})" for i in range(100)]
    assert {tuple(r) for r in gaps.collect()} == {("u.spec.ts", "CLAIM_LIMIT_EXCEEDED", 30), ("u.spec.ts", "SOURCE_TEXT_LIMIT_EXCEEDED", 1)}
