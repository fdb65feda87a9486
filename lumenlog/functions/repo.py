"""Repository names from paths and remotes, and equality under aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders of a home that are no projects (fixed values).
NOT_PROJECTS = ("Documents", "Desktop", "Downloads", "Library", "Applications", "Movies", "Music", "Pictures", "Public", "www")


def structural_repo(cwd: Column, home: str) -> Column:
    """The project that a working directory's path names: worktree layouts first, then folders below home."""
    parts = F.filter(F.split(cwd, "/"), lambda p: p != "")
    at = lambda i: F.try_element_at(parts, i)  # noqa: E731  counts from 1
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    hit = F.filter(numbered, lambda x: (x["i"] > 0) & (x["p"].isin("worktrees", ".worktrees") | x["p"].endswith("-worktrees")))
    wt = F.try_element_at(hit, F.lit(1))
    name, k = wt["p"], wt["i"] + 1  # k: place counted from 1
    owner = at(k - 1)
    worktree = (
        F.when(name.endswith("-worktrees"), F.nullif(F.regexp_replace(name, "-worktrees$", ""), F.lit("")))
        .when(name == ".worktrees", owner)
        .when(owner == ".claude", F.when(k > 2, at(F.greatest(k - 2, F.lit(1)))))
        .otherwise(at(k + 2))
    )
    base = [p for p in home.split("/") if p]
    n = len(base)
    below = F.when(F.slice(parts, 1, n) == F.array(*map(F.lit, base)), F.size(parts) > n).otherwise(False) if n else F.lit(False)
    first = at(F.lit(n + 1))
    inside = F.when(first == "www", F.coalesce(at(F.lit(n + 3)), at(F.lit(n + 2)))).when(first.startswith(".") | first.isin(*NOT_PROJECTS), None).otherwise(first)
    return F.when(~F.coalesce(cwd.startswith("/"), F.lit(False)), None).when(wt.isNotNull(), worktree).when(below, inside)


def repo_of_git_url(url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(F.trim(url), "/+$", ""), "[/:]"), -1)
    return F.nullif(F.regexp_replace(last, r"\.git$", ""), F.lit(""))


def canonical_repo(repo: Column, aliases: dict[str, str]) -> Column:
    """One hop through the alias map."""
    if not aliases:
        return repo
    table = F.create_map(*[F.lit(x) for pair in sorted(aliases.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, repo), repo)


def same_repo(a: Column, b: Column, aliases: dict[str, str] | None = None) -> Column:
    """Null is the same as nothing."""
    return F.coalesce(canonical_repo(a, aliases or {}) == canonical_repo(b, aliases or {}), F.lit(False))
