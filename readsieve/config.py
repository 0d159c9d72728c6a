"""The run's configuration, kept as a small JSON file."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from datetime import datetime

from readsieve.operators.bloom import BloomParams
from readsieve.operators.emission import DNA, KmerSpec
from readsieve.plans.screen import ScreenSpec

# Where things are unless told otherwise.
CONFIG_LOCATION = "/tmp/.readsieve.config"
WATCH_DIRECTORY = "/var/lib/MinKNOW/data/reads"


@dataclass
class Config:
    filename: str | None = None
    created: str | None = None
    modified: str | None = None
    current_log_file: str | None = None
    watch_directory: str | None = None
    white_list: str | None = None
    pid: int = -1
    k_size: int = 7
    sketch_size: int = 128
    bloom_fp_rate: float = 0.001
    bloom_max_elements: int = 100_000

    def screen_spec(self) -> ScreenSpec:
        """The screening parameters, checked."""
        return ScreenSpec(
            kmers=KmerSpec(self.k_size, True, DNA),
            size=self.sketch_size,
            fp_rate=self.bloom_fp_rate,
            filter=BloomParams.of(self.bloom_max_elements, self.bloom_fp_rate),
        )


def timestamp(now: datetime | None = None) -> str:
    """Local time without leading zeros, ``Y-M-D:h-m``."""
    t = now or datetime.now()
    return f"{t.year}-{t.month}-{t.day}:{t.hour}-{t.minute}"


def load(path: str) -> Config:
    """Keys in any order; missing ones keep their defaults, unknown ones are ignored."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    known = {f.name: found[f.name] for f in fields(Config) if f.name in found}
    if not known:
        raise ValueError(f"{path} holds no configuration")
    return Config(**known)


def save(config: Config, path: str) -> None:
    """Write the file in one step, so that a reader never sees half of it."""
    config.filename = path
    config.modified = timestamp()
    config.created = config.created or config.modified
    lines = [f'  "{k}": {v:.6f}' if isinstance(v, float) else f'  "{k}": {json.dumps(v)}' for k, v in asdict(config).items()]
    partial = f"{path}.{os.getpid()}"
    with open(partial, "w", encoding="utf-8") as f:
        f.write("{\n" + ",\n".join(lines) + "\n}\n")
    os.replace(partial, path)


def load_or_create(path: str) -> Config:
    if not os.path.exists(path):
        save(Config(), path)
    return load(path)
