"""Tasks that are skipped while their code hasn't changed."""

from __future__ import annotations

import ast
import hashlib
import inspect
import json
import os
import textwrap
from collections.abc import Callable
from dataclasses import dataclass


def code_digest(function: Callable) -> str:
    """SHA3-224 of the function's syntax tree: comments and layout don't count."""
    tree = ast.parse(textwrap.dedent(inspect.getsource(function)))
    return hashlib.sha3_224(ast.dump(tree).encode()).hexdigest()


def file_digest(path: str) -> str:
    h = hashlib.sha3_224()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


@dataclass(frozen=True)
class Task:
    name: str
    function: Callable
    suffix: str

    @property
    def digest(self) -> str:
        return code_digest(self.function)


def task(suffix: str, name: str | None = None) -> Callable[[Callable], Task]:
    """Makes a task of a function (input, output); ``suffix`` ends the output's path."""
    return lambda f: Task(name or f.__name__, f, suffix)


class JobManager:
    """Runs tasks over inputs, and keeps in ``folder``/jobs.json the digest that each output was made with."""

    def __init__(self, folder: str):
        self.folder, self.jobs = folder, []
        self.path = os.path.join(folder, "jobs.json")

    def add(self, job: str, source: object, task: Task) -> None:
        if any(j == job and t.name == task.name for j, _, t in self.jobs):
            raise ValueError(f"{job} already has the task {task.name}")
        self.jobs.append((job, source, task))

    def run(self, force: bool = False) -> list[str]:
        """The names of the outputs that were made."""
        os.makedirs(self.folder, exist_ok=True)
        known = {}
        if os.path.exists(self.path):
            with open(self.path) as f:
                known = json.load(f)
        made = []
        for job, source, t in self.jobs:
            key, out = f"{job}/{t.name}", os.path.join(self.folder, f"{job}_{t.name}{t.suffix}")
            if not force and known.get(key) == t.digest and os.path.exists(out):
                continue
            t.function(source, out)
            known[key] = t.digest
            with open(self.path + ".write", "w") as f:
                json.dump(known, f, indent=1)
            os.replace(self.path + ".write", self.path)
            made.append(key)
        return made


def rendered_jobs(template: str, jobs: list[dict[str, str]]) -> str:
    """``template`` with the part between {{#jobs}} and {{/jobs}} repeated for each job and its {{fields}} filled in."""
    before, rest = template.split("{{#jobs}}", 1)
    body, after = rest.split("{{/jobs}}", 1)
    out = []
    for job in jobs:
        part = body
        for k, v in job.items():
            part = part.replace("{{" + k + "}}", str(v))
        out.append(part)
    return before + "".join(out) + after
