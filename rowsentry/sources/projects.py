"""Projects on disk: a JSON document and the rules' text, with at most 50 entries of history."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from ..plans.limits import check_project
from .dataset import Dataset
from .versions import Sessions

HISTORY = 50


@dataclass
class Project:
    name: str
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    dataset: str | None = None
    sheet: str | None = None
    description: str = ""
    rules: str = ""
    mappings: dict[str, str] = field(default_factory=dict)
    configurations: dict[str, dict] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)


class ProjectStore:
    def __init__(self, root: str):
        self.root = root

    def _folder(self, name: str) -> str:
        return os.path.join(self.root, str(uuid.UUID(name)))  # anything but a UUID is refused

    def save(self, project: Project) -> None:
        check_project(project.name, project.description)
        folder = self._folder(project.id)
        os.makedirs(folder, exist_ok=True)
        project.history = project.history[-HISTORY:]
        document = asdict(project)
        self._write(os.path.join(folder, "rules.txt"), document.pop("rules"))
        self._write(os.path.join(folder, "project.json"), json.dumps(document, indent=2))

    @staticmethod
    def _write(path: str, text: str) -> None:
        fd, part = tempfile.mkstemp(dir=os.path.dirname(path))
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(part, path)

    def load(self, name: str) -> Project:
        folder = self._folder(name)
        with open(os.path.join(folder, "project.json"), encoding="utf-8") as f, open(os.path.join(folder, "rules.txt"), encoding="utf-8") as r:
            return Project(rules=r.read(), **json.load(f))

    def attach(self, project: Project, path: str, sheet: str | None = None) -> Project:
        """Give a project its source. Mappings and references of another source don't hold for it and go; the rest of each rule's configuration stays."""
        path = os.path.abspath(path)
        if path != project.dataset:
            project.mappings = {}
            project.configurations = {rule: {k: v for k, v in c.items() if k != "reference"} for rule, c in project.configurations.items()}
        project.dataset, project.sheet = path, sheet
        self.save(project)
        return project

    def open(self, project: Project, sessions: Sessions) -> Dataset | None:
        """The dataset of a project's source, none if it has none; a source that changed is loaded anew."""
        return sessions.open(project.dataset, reload=True) if project.dataset else None

    def list(self) -> list[str]:
        return sorted(d for d in os.listdir(self.root) if os.path.exists(os.path.join(self.root, d, "project.json")))

    def keep_analysis(self, project: Project, findings: DataFrame, full: bool = False) -> str:
        """Note an analysis in the history; with ``full``, its findings as Parquet beside the project."""
        name = str(uuid.uuid4())
        project.history.append({"id": name, "at": datetime.now(timezone.utc).isoformat(), "findings": findings.count()})
        if full:
            findings.write.parquet(os.path.join(self._folder(project.id), "analyses", name))
        self.save(project)
        return name
