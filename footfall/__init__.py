"""Visit analytics over click streams, written as Spark DataFrame jobs.

``hits`` (one row per pageview or event) is the only stored fact. Everything
else -- visits, journeys, search, overviews, site roll-ups -- is a function from
DataFrame to DataFrame, so that Catalyst sees one plan from scan to result.
"""
