"""What every interactive shell is started with, and how the settings follow from it."""

from __future__ import annotations

import argparse
import os
from pathlib import Path
from typing import Any

LANES = ("walk", "assign", "propose", "annotate")  # fixed values
TEST_PURPOSE = "feature-test"
WORKSPACE = "PALIMPSEST_WORKSPACE"
MARK = "palimpsest.json"


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="A shell over one source of a workspace.")
    p.add_argument("--workspace", help=f"workspace folder; else ${WORKSPACE}, else the nearest folder upwards that holds {MARK}")
    p.add_argument("--source", help="id of a source, or part of its title")
    p.add_argument("--rendition", help="'raw' or part of a preprocessing's name")
    p.add_argument("--skeleton", help="'legacy' or the start of a skeleton's hash")
    p.add_argument("--actor", default="human")
    p.add_argument("--lane", choices=LANES)
    p.add_argument("--fa-cache", dest="fa_cache", help="table of aligned words; the workspace's own, if missing")
    p.add_argument("--test", action="store_true", help="a session that is no genuine work")
    p.add_argument("--no-autoplay", action="store_true")
    p.add_argument("--no-resume", action="store_true")
    p.add_argument("--audio-device", help="number or part of a name")
    p.add_argument("--shift-floor-ms", type=int, default=0, help="least time between shifts of a held key")
    p.add_argument("--nudge-step-ms", type=float, help="step of a time nudge; what the view state says, if missing")
    return p


def find_workspace(explicit: str | None = None, start: str | None = None) -> str | None:
    """A workspace's folder, or None. Only a local one is looked for; another is named."""
    if named := explicit or os.environ.get(WORKSPACE):
        return named
    here = Path(start or os.getcwd()).resolve()
    return next((str(p) for p in (here, *here.parents) if (p / MARK).is_file()), None)


def resolve_settings(args: argparse.Namespace) -> dict[str, Any]:
    """Seconds instead of milliseconds, the purpose of a test, a numbered device as a number, and the workspace."""
    device = args.audio_device
    return {
        "workspace": find_workspace(args.workspace),
        "purpose": TEST_PURPOSE if args.test else None,
        "audio_device": int(device) if device is not None and device.isdigit() else device,
        "shift_floor_s": args.shift_floor_ms / 1000,
        "nudge_step_s": None if args.nudge_step_ms is None else args.nudge_step_ms / 1000,
        "autoplay": not args.no_autoplay,
        "resume": not args.no_resume,
        **{k: getattr(args, k) for k in ("source", "rendition", "skeleton", "actor", "lane", "fa_cache")},
    }
