from cairn.plans.ordered import *  # noqa: F401,F403
from cairn.plans.quantiles import *  # noqa: F401,F403
from cairn.plans.linear import *  # noqa: F401,F403
from cairn.plans.recurrence import *  # noqa: F401,F403
from cairn.plans.lineage import *  # noqa: F401,F403
from cairn.plans.skew import *  # noqa: F401,F403
