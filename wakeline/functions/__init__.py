from wakeline.functions import angles, geo, grid, text

__all__ = ["angles", "geo", "grid", "text"]
