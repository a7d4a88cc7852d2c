"""The registered queries, one module per area. Importing this package
registers them all; names are ``<area>_<what>``, ``ops`` lists SURVEY ids."""

from tillcast.plans.queries import pipeline  # noqa: F401
from tillcast.plans.queries import preparation  # noqa: F401
from tillcast.plans.queries import exploration  # noqa: F401
from tillcast.plans.queries import profiles  # noqa: F401
from tillcast.plans.queries import series  # noqa: F401
from tillcast.plans.queries import inventory  # noqa: F401
from tillcast.plans.queries import models  # noqa: F401
from tillcast.plans.queries import io  # noqa: F401
from tillcast.plans.queries import recursive  # noqa: F401
