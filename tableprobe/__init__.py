"""tableprobe: table profiling and data-quality reports as Spark DataFrames."""

from tableprobe.dataset import Dataset
from tableprobe.plans.profile import Profile, profile_tables

__all__ = ["Dataset", "Profile", "profile_tables"]
