"""Type references and their resolution, as joins.

A reference, a declaration id with arguments that are references, is an array of (id, depth) in the
order they are written: `Map[K, List[V]]` is Map 0, K 1, List 1, V 2. So trees of any depth are one flat
column that groups, joins and substitutes by array functions. Resolution steps all references of all modules at
once and ends when none moves any more; a module is never one task.

declarations have module_id, declaration_id, kind, sig_kind (type, class, method, value), type_parameters
(array<string>), parents (array of references), upper, lower (of a type) and result (of a method or value).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lineage import counted, forget, gathered, held, materialise, pieces

REF = "array<struct<id: string, depth: int>>"


# ---- references as columns ---------------------------------------------------------------------


def _deeper(ref: Column, by: int) -> Column:
    return F.transform(ref, lambda n: F.struct(n["id"].alias("id"), (n["depth"] + by).alias("depth")))


def ref(ident: Column, *args: Column) -> Column:
    """A reference of an id and references."""
    head = F.array(F.struct(ident.alias("id"), F.lit(0).alias("depth")))
    return F.when(ident.isNotNull(), F.concat(head, *(_deeper(a, 1) for a in args)))


def with_arguments(ident: Column, args: Column) -> Column:
    """A reference of an id and an array of references."""
    head = F.array(F.struct(ident.alias("id"), F.lit(0).alias("depth")))
    return F.concat(head, F.flatten(F.transform(args, lambda a: _deeper(a, 1))))


def head(r: Column) -> Column:
    return F.get(r, 0)["id"]


def arguments(r: Column) -> Column:
    """The direct arguments, an array of references."""
    at = F.filter(F.transform(r, lambda n, i: F.when(n["depth"] == 1, i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(at, 2, F.size(r)), F.array(F.size(r)))
    cuts = F.filter(F.arrays_zip(at.alias("a"), ends.alias("b")), lambda x: x["a"].isNotNull())
    return F.transform(cuts, lambda x: _deeper(F.slice(r, x["a"] + 1, x["b"] - x["a"]), -1))


def as_code(r: Column) -> Column:
    """`id[argument,argument]`."""
    before = lambda i: F.get(r, i - 1)["depth"]
    close = lambda n, i: F.concat(F.repeat(F.lit("]"), before(i) - n["depth"]), F.lit(","))
    piece = lambda n, i: F.concat(F.when(i == 0, "").when(n["depth"] > before(i), "[").otherwise(close(n, i)), n["id"])
    return F.concat(F.array_join(F.transform(r, piece), ""), F.repeat(F.lit("]"), F.element_at(r, -1)["depth"]))


def _replaced(a: Column, params: Column, args: Column) -> Column:
    """The argument given for a, if a is one of the parameters."""
    at = F.array_position(params, head(a)).cast("int")
    return F.when((F.size(a) == 1) & (at > 0), F.get(args, at - 1))


def substitute(r: Column, params: Column, args: Column) -> Column:
    """Direct arguments of r that are type parameters replaced by what is given for these, whose own direct arguments are
    replaced likewise once."""
    inner = lambda x: with_arguments(head(x), F.transform(arguments(x), lambda b: F.coalesce(_replaced(b, params, args), b)))
    given = lambda a: _replaced(a, params, args)
    return F.when(r.isNotNull(), with_arguments(head(r), F.transform(arguments(r), lambda a: F.when(given(a).isNotNull(), inner(given(a))).otherwise(a))))


def count_parameters(args: DataFrame, declarations: DataFrame) -> DataFrame:
    """args: module_id, owner, args (array of references). (module_id, owner, num_type_arguments, num_type_argument_refs, missing): how
    many there are, how many are type parameters, and how many the module lacks."""
    each = args.select("module_id", "owner", F.explode_outer("args").alias("a")).select("module_id", "owner", head(F.col("a")).alias("declaration_id"))
    kinds = declarations.select("module_id", "declaration_id", "kind")
    found = held(each).join(kinds, ["module_id", "declaration_id"], "left").groupBy("module_id", "owner")
    absent = F.col("declaration_id").isNotNull() & F.col("kind").isNull()
    return found.agg(F.count("declaration_id").cast("int").alias("num_type_arguments"), F.count_if(F.col("kind") == "TYPE_PARAMETER").cast("int").alias("num_type_argument_refs"), F.count_if(absent).alias("missing"))


# ---- declarations: aliases, kinds, parents ------------------------------------------------------


def resolved_types(declarations: DataFrame) -> DataFrame:
    """declarations: module_id, declaration_id, sig_kind, upper, lower (ids). (module_id, declaration_id, resolved_id) of all:
    types followed to their bound, upper before lower, until something that isn't a type or has no bound, or whose
    bound was met before: a declaration in a cycle is its own, one that leads into a cycle is resolved
    to the cycle's declaration before the one it enters by.

    By pointer doubling, each round twice as many steps: as many rounds as the logarithm of the longest chain. A round that
    shortens no chain leaves cycles alone.
    """
    key = ["module_id", "declaration_id"]
    target = F.when(F.col("sig_kind") == "type", F.coalesce("upper", "lower"))
    links = materialise(declarations.select(*key, target.alias("to")).where("to IS NOT NULL").distinct())

    def double(done: DataFrame, opened: DataFrame) -> tuple[DataFrame, int]:
        """Twice the steps for the opened, which lead to opened or done ones."""
        step = done.unionByName(opened).select("module_id", F.col("declaration_id").alias("to"), F.col("to").alias("next"), F.col("done").alias("next_done"))
        rows = opened.join(held(step), ["module_id", "to"], "left").select(*key, F.coalesce("next", "to").alias("to"), F.coalesce("next_done", F.lit(True)).alias("done"))
        return counted(rows, ~F.col("done"))

    start = links.select("module_id", F.col("declaration_id").alias("to"), F.lit(True).alias("linked")).distinct()
    at, left = counted(links.join(held(start), ["module_id", "to"], "left").select(*key, "to", F.col("linked").isNull().alias("done")), ~F.col("done"))
    done, opened = at.where("done"), at.where("NOT done")
    while left:
        before = left
        moved, left = double(done, opened)
        done, opened = done.unionByName(moved.where("done")), moved.where("NOT done")
        if left == before:
            break
    resolved = done.select(*key, F.col("to").alias("resolved_id"))
    if left:
        resolved = resolved.unionByName(_cycles(links, opened.select(*key, "to"), double))
    return declarations.select(*key).distinct().join(held(resolved), key, "left").select(*key, F.coalesce("resolved_id", "declaration_id").alias("resolved_id"))


def _cycles(links: DataFrame, at: DataFrame, double) -> DataFrame:
    """(key, resolved_id) of declarations that lead into cycles. at: these, with where some steps lead."""
    key = ["module_id", "declaration_id"]
    next_of = links.select("module_id", F.col("declaration_id").alias("to"), F.col("to").alias("next"))
    while True:  # until what is led to is in cycles: its successors are then as many
        on = materialise(at.select("module_id", "to").distinct())
        sizes = [on.count(), on.join(next_of, ["module_id", "to"]).select("module_id", "next").distinct().count()]
        if sizes[0] == sizes[1]:
            break
        step = at.select("module_id", F.col("declaration_id").alias("to"), F.col("to").alias("next"))
        at = materialise(at.join(step, ["module_id", "to"]).select(*key, F.col("next").alias("to")))
    cycle = on.withColumnRenamed("to", "declaration_id")
    tails = at.select(*key).join(cycle, key, "left_anti").join(links, key)
    ends = cycle.select("module_id", F.col("declaration_id").alias("to"), F.lit(True).alias("end"))
    tails, left = counted(tails.join(ends, ["module_id", "to"], "left").select(*key, "to", F.col("end").isNotNull().alias("done")), ~F.col("done"))
    tails, opened = tails.where("done"), tails.where("NOT done")
    while left:
        moved, left = double(tails, opened)
        tails, opened = tails.unionByName(moved.where("done")), moved.where("NOT done")
    previous = cycle.join(links, key).select("module_id", "to", F.col("declaration_id").alias("resolved_id"))
    led = tails.join(previous, ["module_id", "to"]).select(*key, "resolved_id")
    return led.unionByName(cycle.select(*key, F.col("declaration_id").alias("resolved_id")))


def declared_types(declarations: DataFrame) -> DataFrame:
    """resolved_types() of declarations whose bounds are references."""
    return resolved_types(declarations.select("module_id", "declaration_id", "sig_kind", head(F.col("upper")).alias("upper"), head(F.col("lower")).alias("lower")))


def types_of(declarations: DataFrame, target: str, resolved: DataFrame) -> DataFrame:
    """(module_id, declaration_id) that are the target, or a TYPE resolved to it. resolved: declared_types(), of aliases at least."""
    own = declarations.where(F.col("declaration_id") == target).select("module_id", "declaration_id")
    kinds = declarations.where("kind = 'TYPE'").select("module_id", "declaration_id")
    return own.unionByName(resolved.where(F.col("resolved_id") == target).join(held(kinds), ["module_id", "declaration_id"], "left_semi").select("module_id", "declaration_id")).distinct()


def _upwards(declarations: DataFrame, resolved: DataFrame) -> DataFrame:
    """(module_id, declaration_id, up): from classes to their parents, from types to what they resolve to."""
    parents = declarations.where("sig_kind = 'class'").select("module_id", "declaration_id", F.explode("parents").alias("p")).select("module_id", "declaration_id", head(F.col("p")).alias("up"))
    types = declarations.where("sig_kind = 'type'").select("module_id", "declaration_id").join(held(resolved), ["module_id", "declaration_id"]).where("resolved_id <> declaration_id")
    return pieces(parents, types.select("module_id", "declaration_id", F.col("resolved_id").alias("up")))


def kinds_of(declarations: DataFrame, target: str, resolved: DataFrame) -> DataFrame:
    """(module_id, declaration_id) that are the target, a class with such a parent, or a type resolved to such; found backwards
    from the target, a step of inheritance a round, until nothing is added: for one target that little inherits from. kind_closure()
    answers for all targets. resolved: declared_types(), of aliases at least."""
    edges = gathered(_upwards(declarations, resolved))
    found = frontier = edges.select("module_id").distinct().select("module_id", F.lit(target).alias("declaration_id"))
    while True:
        more = edges.join(held(frontier.select("module_id", F.col("declaration_id").alias("up"))), ["module_id", "up"]).select("module_id", "declaration_id").distinct()
        frontier, added = counted(more.join(held(found), ["module_id", "declaration_id"], "left_anti"), F.lit(True))
        if not added:
            return found
        found = found.unionByName(frontier)


def kind_closure(declarations: DataFrame, resolved: DataFrame, targets: tuple[str, ...] | None = None) -> DataFrame:
    """(module_id, declaration_id, kind_of): all that each declaration is a kind of but itself, so that asking is one join. With targets, ids, these
    alone, followed downwards from them: what leads to none of them is never joined."""
    up = _upwards(declarations, resolved)
    if targets is None:
        up = up.select("module_id", F.col("declaration_id").alias("id"), F.col("up").alias("parent_id"))
        return ancestors(up).select("module_id", F.col("id").alias("declaration_id"), F.col("ancestor_id").alias("kind_of"))
    key, edges = ["module_id", "declaration_id", "kind_of"], gathered(up)
    found = [materialise(edges.where(F.col("up").isin(*targets)).select("module_id", "declaration_id", F.col("up").alias("kind_of")).distinct())]
    while True:
        more = edges.join(held(found[-1].withColumnRenamed("declaration_id", "up")), ["module_id", "up"]).select(*key).distinct()
        for known in found:
            more = more.join(held(known), key, "left_anti")
        more, added = counted(more, F.lit(True))
        if not added:
            return reduce(DataFrame.unionByName, found)
        found.append(more)


def parent_declarations(declarations: DataFrame) -> DataFrame:
    """(module_id, declaration_id, position, parent_id): parents of classes, ids alone."""
    rows = declarations.where("sig_kind = 'class'").select("module_id", "declaration_id", F.posexplode("parents").alias("position", "p"))
    return rows.select("module_id", "declaration_id", "position", head(F.col("p")).alias("parent_id"))


def grandparent_declarations(declarations: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(module_id, declaration_id, parent_id, place): a class's parents, then theirs, each once, by place; two levels and
    no more. of: (module_id, declaration_id) of the classes asked for, all if None."""
    every = parent_declarations(declarations)
    up = every if of is None else every.join(held(of), ["module_id", "declaration_id"], "left_semi")
    above = every.select("module_id", F.col("declaration_id").alias("parent_id"), F.col("position").alias("second"), F.col("parent_id").alias("above"))
    both = up.select("module_id", "declaration_id", "parent_id", F.struct(F.lit(0).alias("a"), "position", F.lit(0).alias("c")).alias("place"))
    second = up.join(above, ["module_id", "parent_id"]).select("module_id", "declaration_id", F.col("above").alias("parent_id"), F.struct(F.lit(1).alias("a"), "position", F.col("second").alias("c")).alias("place"))
    return both.unionByName(second).groupBy("module_id", "declaration_id", "parent_id").agg(F.min("place").alias("place"))


def ancestors(parents: DataFrame) -> DataFrame:
    """parents: module_id, id, parent_id. (module_id, id, ancestor_id, depth) closure, nearest depth of each; in a cycle each is
    its own ancestor too.

    Rounds double the distance: after k of them all pairs nearer than 2^k are known. A pair from there to 2^(k+1) goes by an ancestor at exactly
    2^k and from it to one that is known, so each pair is made once or a few times, and a chain of 300 takes nine rounds.
    """
    key = ["module_id", "id", "ancestor_id"]
    exact = materialise(parents.select("module_id", "id", F.col("parent_id").alias("ancestor_id")).distinct())
    known, length = exact.withColumn("depth", F.lit(1)), 1
    hop = lambda right: exact.select("module_id", "id", F.col("ancestor_id").alias("by")).join(right.withColumnRenamed("id", "by"), ["module_id", "by"])
    while True:
        # known: nearer than 2 * length, for the first round; exact: at length
        further = hop(exact).select(*key).distinct().join(known, key, "left_anti")
        exact, left = counted(further, F.lit(True))
        if not left:
            return known
        length *= 2
        new = hop(known).select(*key, (F.col("depth") + length).alias("depth")).unionByName(exact.withColumn("depth", F.lit(length)))
        new = new.groupBy(*key).agg(F.min("depth").alias("depth")).join(known, key, "left_anti")
        known = known.unionByName(materialise(new))


# ---- references: resolution and inheritance -----------------------------------------------------


def resolved_refs(declarations: DataFrame, refs: DataFrame) -> DataFrame:
    """refs: module_id, ref. (module_id, ref, resolved, missing) of each distinct one: a class is itself; a type is its bound,
    upper before lower, with parameters replaced, resolved on; a value is its type, a method its result, as they are.
    A type whose bound was met before is itself. missing: an id that the module lacks, or null.
    """
    info = declarations.select("module_id", F.col("declaration_id").alias("h"), "sig_kind", "type_parameters", F.coalesce("upper", "lower").alias("bound"), "result")
    work = refs.select("module_id", "ref").where("ref IS NOT NULL").distinct().select("module_id", "ref", F.col("ref").alias("cur"), F.array().cast("array<string>").alias("seen"))
    finished = None
    while True:
        # references are few beside declarations, which stream past them
        rows = held(work.withColumn("h", head(F.col("cur")))).join(info, ["module_id", "h"], "left")
        goes = (F.col("sig_kind") == "type") & F.col("bound").isNotNull()
        ends = F.array_contains(F.concat("seen", F.array("h")), head(F.col("bound")))
        goes = F.coalesce(goes & ~ends, F.lit(False))
        rows = rows.select(
            "module_id", "ref", goes.alias("goes"), F.concat("seen", F.array("h")).alias("seen"), F.when(F.col("sig_kind").isNull(), F.col("h")).alias("missing"),
            F.when(goes, substitute(F.col("bound"), F.col("type_parameters"), arguments(F.col("cur")))).when(F.col("sig_kind").isin("value", "method"), F.coalesce("result", "cur")).otherwise(F.col("cur")).alias("cur"),
        )
        rows, left = counted(rows, F.col("goes"))
        done = rows.where("NOT goes").select("module_id", "ref", F.col("cur").alias("resolved"), "missing")
        finished = done if finished is None else finished.unionByName(done)
        if not left:
            return finished
        work = rows.where("goes").select("module_id", "ref", "cur", "seen")


def fully_resolved_refs(declarations: DataFrame, refs: DataFrame) -> DataFrame:
    """As resolved_refs(), and each direct argument resolved once."""
    first = resolved_refs(declarations, refs)
    args = first.select("module_id", "ref", F.posexplode(arguments(F.col("resolved"))).alias("i", "arg"))
    known = resolved_refs(declarations, args.select("module_id", F.col("arg").alias("ref"))).select("module_id", F.col("ref").alias("arg"), F.col("resolved").alias("to"), F.col("missing").alias("lacks"))
    each = args.join(held(known), ["module_id", "arg"]).groupBy("module_id", "ref").agg(F.array_sort(F.collect_list(F.struct("i", "to"))).alias("args"), F.min("lacks").alias("lacks"))
    rows = first.join(held(each), ["module_id", "ref"], "left")
    whole = F.when(F.col("args").isNotNull(), with_arguments(head(F.col("resolved")), F.col("args")["to"])).otherwise(F.col("resolved"))
    return rows.select("module_id", "ref", whole.alias("resolved"), F.coalesce("missing", "lacks").alias("missing"))


def all_parents(declarations: DataFrame, refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """refs: module_id, ref; resolved: declared_types(), of aliases at least. (module_id, ref, parent, place): the parents of each, with parameters replaced, then the first
    parent's own and theirs, then the second's, each once at its first place; places are in order.

    A place is the way to a parent, for each step whether it goes on and the parent's number, so that direct parents
    come first and arrays compare as the order says. A round goes up one step from all places that are new or
    nearer than before; ways through a cycle only grow, so that rounds end.
    """
    own = declarations.where("sig_kind = 'class'").where(F.size("parents") > 0).select("module_id", F.col("declaration_id").alias("h"), "type_parameters", "parents")
    types = declarations.where("sig_kind = 'type'").select("module_id", "declaration_id")
    by_alias = resolved.where("resolved_id <> declaration_id").join(held(types), ["module_id", "declaration_id"], "left_semi").withColumnRenamed("resolved_id", "h").join(held(own), ["module_id", "h"])
    up = materialise(own.unionByName(by_alias.select("module_id", F.col("declaration_id").alias("h"), "type_parameters", "parents")))
    frontier = refs.select("module_id", "ref").where("ref IS NOT NULL").distinct().select("module_id", "ref", F.col("ref").alias("cur"), F.array().cast("array<int>").alias("way"))
    key, betters = ["module_id", "ref", "parent"], []
    while True:
        rows = held(frontier.withColumn("h", head(F.col("cur")))).join(up, ["module_id", "h"])
        rows = rows.select("module_id", "ref", "way", "cur", "type_parameters", F.posexplode("parents").alias("i", "p"))
        parent = substitute(F.col("p"), F.col("type_parameters"), arguments(F.col("cur")))
        rows = rows.select("module_id", "ref", parent.alias("parent"), F.concat("way", F.array(F.lit(0), F.col("i"))).alias("place"))
        rows = rows.groupBy(*key).agg(F.min("place").alias("place"))
        if betters:
            best = reduce(DataFrame.unionByName, betters).groupBy(*key).agg(F.min("place").alias("was"))
            rows = rows.join(held(best), key, "left").where("was IS NULL OR place < was").drop("was")
        better, left = counted(rows, F.lit(True))
        betters.append(better)
        if not left:
            return reduce(DataFrame.unionByName, betters).groupBy(*key).agg(F.min("place").alias("place"))
        on = F.transform("place", lambda x, i: F.when(i == F.size("place") - 2, 1).otherwise(x))
        frontier = better.select("module_id", "ref", F.col("parent").alias("cur"), on.alias("way"))
