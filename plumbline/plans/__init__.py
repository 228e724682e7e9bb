from plumbline.plans.layout import Layout, Track, exact_quantiles, lay
from plumbline.plans.session import build_session, ensure_checkpoint_dir, ship_package

__all__ = ["Layout", "Track", "exact_quantiles", "lay", "build_session", "ensure_checkpoint_dir",
           "ship_package"]
