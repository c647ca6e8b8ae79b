from deltaview.streaming.observe import AlignedViews, EffectOnce, diff_maps, diff_sets, page, pages
from deltaview.streaming.state import BucketTable
from deltaview.streaming.views import IncrementalView, Input

__all__ = ["AlignedViews", "BucketTable", "EffectOnce", "IncrementalView", "Input", "diff_maps", "diff_sets", "page", "pages"]
