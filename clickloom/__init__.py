"""clickloom: retail clickstream analytics as Spark DataFrame transformations.

Every operator takes a DataFrame of events and returns a DataFrame.  Events
carry the columns of ``clickloom.sources.schema.EVENTS``; extra columns are
ignored, except ``event_id`` which, when present, breaks ties between events
with the same time.
"""

__version__ = "0.1.0"
