"""Tables that outlive a plan, in the folder that all executors share."""

from fathomline.sources.shared import checkpoint_dir, stored

__all__ = ["checkpoint_dir", "stored"]
