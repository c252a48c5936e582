"""skillscope: expertise and skill analytics as lazy Spark DataFrame plans.

Subpackages
-----------
sources    -- table schemas, readers/sinks, bindings from the driver tables
functions  -- column-expression helpers (text cleaning, stemming, scores)
operators  -- reusable DataFrame operators (exact percentiles, tagging, sampling)
plans      -- the user-level composites (features, cohorts, model, skills, search)
streaming  -- the discussion-tagging branch over a streaming source
"""

__all__ = ["config", "session"]
