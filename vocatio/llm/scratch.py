"""Tables written to the folder that all executors share (``vocatio.plans.stored``)."""

from vocatio.plans.stored import new_path, root, written

__all__ = ["new_path", "root", "written"]
