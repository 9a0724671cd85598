"""Image datasets and anomaly scores as Spark jobs."""

from framescore.session import SCALE_CONF, build_session, cut_lineage, shared_dir, ship_package

__all__ = ["SCALE_CONF", "build_session", "cut_lineage", "shared_dir", "ship_package"]
