"""Parameters of detection, in microns as given and in pixels as used."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

from volumetra.functions.dtypes import filtering_dtype, max_exact


@dataclass(frozen=True, kw_only=True)
class DetectionSettings:
    dtype: str = "uint16"
    voxel_sizes: tuple[float, float, float] = (5.0, 2.0, 2.0)  # z, y, x
    soma_diameter_um: float = 16
    max_cluster_size_um3: float = 100_000
    ball_xy_size_um: float = 6
    ball_z_size_um: float = 15
    ball_overlap_fraction: float = 0.6
    soma_spread_factor: float = 1.4
    log_sigma_size: float = 0.2
    n_sds_above_mean_thresh: float = 10
    tiled_thresh_tile_size: float | None = None
    n_sds_above_mean_tiled_thresh: float = 10
    start_plane: int = 0
    end_plane: int = -1
    split_ball_xy_size_um: float = 6
    split_ball_z_size_um: float = 15
    split_ball_overlap_fraction: float = 0.8
    n_splitting_iter: int = 10
    z_feedback: bool = False  # marks count as bright for the planes behind them, after each batch of planes
    batch_size: int = 1
    correct_split_offset: bool = False
    slab_planes: int = field(default=16)

    @classmethod
    def from_dict(cls, given: dict) -> "DetectionSettings":
        known = {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**given)

    @property
    def clip_value(self) -> int:
        return max_exact(self.dtype) - 2

    @property
    def in_plane(self) -> float:
        return (self.voxel_sizes[1] + self.voxel_sizes[2]) / 2

    @property
    def soma_diameter(self) -> int:
        return round(self.soma_diameter_um / self.in_plane)

    @property
    def max_cluster_size(self) -> int:
        return round(self.max_cluster_size_um3 / math.prod(self.voxel_sizes))

    @property
    def ball_xy(self) -> int:
        return round(self.ball_xy_size_um / self.in_plane)

    @property
    def ball_z(self) -> int:
        n = round(self.ball_z_size_um / self.voxel_sizes[0])
        if not n:
            raise ValueError("the ball has no plane: its z size is too small for these voxels")
        return n

    @property
    def split_ball(self) -> tuple[int, int]:
        return round(self.split_ball_xy_size_um / self.in_plane), round(self.split_ball_z_size_um / self.voxel_sizes[0])

    @property
    def tile(self) -> int:
        return 2 * self.soma_diameter

    @property
    def sigma(self) -> float:
        return self.log_sigma_size * self.soma_diameter

    @property
    def max_cell_volume(self) -> float:
        return 4 / 3 * math.pi * (self.soma_spread_factor * self.soma_diameter / 2) ** 3


def plane_name(number: int, planes: int) -> str:
    return f"plane_{number:0{max(4, math.ceil(math.log10(planes)))}d}"


def check_volume(dtype: str, shape: tuple[int, ...]) -> None:
    """Refuse what cannot be filtered: the type is looked at before the rank."""
    filtering_dtype(dtype)
    if len(shape) != 3:
        raise ValueError(f"a volume has 3 axes, not {len(shape)}")


def check_rank(axes: int) -> None:
    """Data and networks are planes or volumes."""
    if axes not in (2, 3):
        raise ValueError(f"data has 2 or 3 axes, not {axes}")


def learning_rate(epoch: int, start: float = 1e-4, steps: tuple[int, ...] = (), factor: float = 0.1) -> float:
    return start * factor ** sum(epoch >= s for s in steps)


def readable_bytes(n: float) -> str:
    """Decimal units."""
    for unit in ("bytes", "KB", "MB", "GB", "TB"):
        if n < 1000:
            return f"{n:.1f} {unit}"
        n /= 1000
    return f"{n:.1f} PB"


def bins_of(sizes, widths):
    """Whole bins along each axis; tuples or dicts by axis."""
    if isinstance(sizes, dict):
        return {k: int(v / widths[k]) for k, v in sizes.items()}
    return tuple(int(a / b) for a, b in zip(sizes, widths))


#: Steps from a pixel to those that share an edge with it.
FOUR_CONNECTED = ((-1, 0), (0, -1), (0, 1), (1, 0))
