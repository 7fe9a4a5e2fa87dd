"""Schemas, parameters and errors."""

from __future__ import annotations

import logging
from dataclasses import dataclass, fields, replace
from enum import Enum, IntFlag

COO = "mid string, i long, j long, v double"
COOZ = "mid string, i long, j long, re double, im double"
VEC = "mid string, i long, x double"
META = "mid string, nrows long, ncols long, is_complex boolean, symmetry string"


_LOG = logging.getLogger("stratum")


class SolverError(Exception):
    """Any error of the engine."""


class SizeMismatch(SolverError):
    """Matrices or vectors whose sizes do not fit."""


class BadPreconditioner(SolverError):
    """A preconditioner that is missing or unusable."""


class BadInput(SolverError):
    """A matrix or file that breaks the format's rules."""


class Verbose(IntFlag):
    NONE = 0
    WARN = 1
    INFO = 2
    PRE = 4
    FAC = 8


class Reorder(Enum):
    OFF = "off"
    AUTO = "auto"
    AMD = "amd"
    RCM = "rcm"


class Pivot(Enum):
    OFF = "off"
    ON = "on"
    AUTO = "auto"


class Dense(Enum):
    QRCP = "qrcp"
    LUP = "lup"


@dataclass(frozen=True)
class Params:
    """Control of factorisation; an instance never changes, ``with_*`` give new ones."""

    tau_L: float = 1e-4
    tau_U: float = 1e-4
    kappa_d: float = 3.0
    kappa: float = 3.0
    alpha_L: float = 10.0
    alpha_U: float = 10.0
    rho: float = 0.5
    c_d: float = 10.0
    c_h: float = 2.0
    N: int = -1
    verbose: Verbose = Verbose.WARN
    rf_par: int = 1
    reorder: Reorder = Reorder.AMD
    spd: int = 0
    check: int = 1
    pre_scale: int = 0
    symm_pre_lvls: int = -2
    threads: int = 0
    mumps_blr: int = 1
    fat_schur_1st: int = 0
    rrqr_cond: float = 0.0
    pivot: Pivot = Pivot.AUTO
    gamma: float = 1.0
    beta: float = 1e3
    is_symm: int = 0
    no_pre: int = 0
    nzp_thres: float = 0.65
    dense_thres: int = 2000
    # Further fields: the dense solver, single precision factors, switches that change results, the norm of QRCP's rank.
    dense: Dense = Dense.QRCP
    single: int = 0
    drop_off_diagonal: int = 1
    drop_space: int = 1
    rank_norm: int = 2

    def with_value(self, name: str, value) -> Params:
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if name not in kinds:
            raise BadInput(f"unknown parameter {name}")
        return replace(self, **{name: kinds[name](value)})

    def with_droptol(self, tau: float, tau_U: float | None = None) -> Params:
        return replace(self, tau_L=tau, tau_U=tau if tau_U is None else tau_U)

    def with_alpha(self, alpha: float, alpha_U: float | None = None) -> Params:
        return replace(self, alpha_L=alpha, alpha_U=alpha if alpha_U is None else alpha_U)

    def with_kappa(self, kappa: float, kappa_d: float | None = None) -> Params:
        return replace(self, kappa=kappa, kappa_d=kappa if kappa_d is None else kappa_d)

    def text(self) -> str:
        """The values in the order of the fields, as ``read`` takes them."""
        values = (getattr(self, f.name) for f in fields(self))
        return " ".join(str(int(v)) if isinstance(v, IntFlag) else v.value if isinstance(v, Enum) else repr(v) for v in values)

    def __str__(self) -> str:
        """A field a line; verbosity and orders by name."""
        shown = ((f.name, getattr(self, f.name)) for f in fields(self))
        return "\n".join(f"{name:<18}{v.name.lower() if isinstance(v, Enum) else v}" for name, v in shown)

    def says(self, kind: Verbose) -> bool:
        return bool(self.verbose & kind)

    def say(self, kind: Verbose, text: str, *values) -> None:
        """Logs under ``stratum`` if ``verbose`` has the kind's bit; on executors into their logs."""
        if self.says(kind):
            _LOG.log(logging.WARNING if kind is Verbose.WARN else logging.INFO, text, *values)

    @classmethod
    def read(cls, text: str) -> Params:
        """Values in the order of the fields, separated by white space."""
        out = cls()
        for f, value in zip(fields(cls), text.split()):
            kind = type(getattr(out, f.name))
            if issubclass(kind, IntFlag):
                out = replace(out, **{f.name: kind(int(value))})
            else:
                out = out.with_value(f.name, float(value) if kind is float else int(value) if kind is int else value)
        return out

    def at_level(self, level: int) -> Params:
        """Thresholds for a level: on deeper levels stricter conditioning and dropping, more room on the second."""
        if not self.rf_par:
            return self
        f = min(level, 2)
        bound = lambda k: max(2.0, k ** (1 / f))
        cut, room = min(10.0, 10.0 ** (level - 1)), f if level <= 2 else 1
        return replace(self, kappa=bound(self.kappa), kappa_d=bound(self.kappa_d), tau_L=self.tau_L / cut, tau_U=self.tau_U / cut, alpha_L=self.alpha_L * room, alpha_U=self.alpha_U * room)
