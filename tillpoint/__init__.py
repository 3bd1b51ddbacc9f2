"""tillpoint: retail, finance and HR analytics for multi-tenant shop data on PySpark.

Read models (dashboards, nested documents, reports), batch operators that apply
request tables to current tables, data-quality jobs and a few Structured
Streaming forms.  Every operator takes an explicit ``as_of`` and keeps money in
decimals until the output boundary.
"""

from tillpoint.session import get_session, ensure_session_defaults

__all__ = ["get_session", "ensure_session_defaults"]
