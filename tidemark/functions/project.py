"""What is read off a message, a branch or a path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks messages that no person wrote.
NOISE_PARTS = ["[Request interrupted", "Your task is to create a detailed summary", "<local-command-caveat>"]
NOISE_TEXTS = ["Tool loaded.", "Tool loaded"]
BOILERPLATE = ["Base directory for this skill:", "Read and execute ~/", "Read and return the full contents", "<task-notification>", "<system-reminder>"]
#: Branch prefixes and words, in order of precedence.
BRANCH_PREFIXES = {"fix/": "bugfix", "bugfix/": "bugfix", "hotfix/": "bugfix", "feature/": "feature", "feat/": "feature", "refactor/": "refactor", "chore/": "chore", "docs/": "docs", "test/": "test", "ci/": "ci", "release/": "release", "review/": "review"}
BRANCH_WORDS = {"fix": "bugfix", "bug": "bugfix", "feature": "feature", "refactor": "refactor"}
#: Phrases of proposals and confirmations, and openings of new topics.
PROPOSALS = ["i'll ", "i will ", "let me ", "i propose ", "i suggest ", "should we ", "i recommend ", "the approach is ", "i'm going to ", "i am going to ", "my plan is ", "here's what i'll ", "here's my plan", "the plan is ", "i intend to ", "we should ", "i'd like to "]
CONFIRMATIONS = ["yes", "yeah", "yep", "go ahead", "sounds good", "perfect", "do it", "approved", "lgtm", "looks good", "that works", "correct", "right", "exactly", "proceed", "ship it", "merge it", "ok", "okay", "sure", "great", "good", "please do", "please proceed", "make it so", "sounds right", "agreed", "agree", "done", "let's do it", "let's go"]
NEW_TOPICS = ["now ", "next ", "also ", "another ", "switch ", "instead ", "let's ", "lets ", "ok ", "okay ", "new ", "implement ", "fix ", "add ", "write ", "create ", "start "]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_noise(text: Column) -> Column:
    return any_of([text.contains(p) for p in NOISE_PARTS]) | text.isin(NOISE_TEXTS) | (text.contains("<command-name>") & (F.octet_length(text) < 200))


def is_boilerplate(text: Column) -> Column:
    return any_of([text.startswith(p) for p in BOILERPLATE])


def work_type(branch: Column) -> Column:
    """Kind of work that a branch name tells; empty without a branch."""
    b = F.lower(branch)
    out = F.when(F.coalesce(branch, F.lit("")).isin("", "HEAD"), "")
    for prefix, kind in BRANCH_PREFIXES.items():
        out = out.when(b.startswith(prefix), kind)
    for word, kind in BRANCH_WORDS.items():
        out = out.when(b.contains(word), kind)
    return out.when(b.isin("master", "main", "dev", "develop"), "development").otherwise("branch-work")


def session_type(project: Column) -> Column:
    return F.when(project == "subagents", "subagent").when(project.ilike("%worktrees%"), "worktree").when(project.ilike("%-private-tmp%"), "ephemeral").otherwise("interactive")


def repo_of(path: Column) -> Column:
    """owner/name of a working directory below a checkout root, else empty."""
    return F.regexp_extract(F.translate(path, "\\", "/"), r"/work/github\.com/([^/]+/[^/]+)", 1)


def remote_repo(url: Column) -> Column:
    """owner/name of a remote's address, by ssh or http."""
    return F.regexp_extract(url, r"[:/]([^/:]+/[^/]+?)(?:\.git)?/?$", 1)


def is_proposal(text: Column) -> Column:
    return (F.octet_length(text) >= 50) & any_of([F.contains(F.lower(text), F.lit(p)) for p in PROPOSALS])


def is_confirmation(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(text)), r"[.!?,]+$", "")
    tests = [(t == p) | t.startswith(p + " ") | t.endswith(" " + p) for p in CONFIRMATIONS]
    return (F.octet_length(t) <= 60) & any_of(tests)


def opens_topic(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return any_of([t.startswith(p) for p in NEW_TOPICS])


def context_window(model: Column) -> Column:
    return F.when(model.endswith("[1m]"), F.lit(1_000_000)).otherwise(F.lit(200_000))


def sql_shape(text: Column) -> Column:
    """A statement with literals and numbers as ?, lower case and single blanks: what repeated queries have in common."""
    t = F.regexp_replace(text, r"'[^']*'", "?")
    t = F.regexp_replace(t, r"\b[0-9]+(?:\.[0-9]+)?\b", "?")
    return F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))
