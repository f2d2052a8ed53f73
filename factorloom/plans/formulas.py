"""The fundamental features in DuckDB SQL, written down by themselves, to check the library's formulas.

Plain columns are the filing's own values; p is the filing a year before, q0 to q7 those known of the latest quarters, as structs that
may be null. A division by zero or by nothing gives null. One feature a line: name = expression.
"""

from __future__ import annotations

#: named before the features: growth of property by quarter, income over assets of the quarters at hand, margins
STEPS = """
g0 = CASE WHEN q0.revenueusd = 0 THEN (q0.ppnenet - q1.ppnenet) / 100 ELSE (q0.ppnenet - q1.ppnenet) / q0.revenueusd END
g1 = CASE WHEN q1.revenueusd = 0 THEN (q1.ppnenet - q2.ppnenet) / 100 ELSE (q1.ppnenet - q2.ppnenet) / q1.revenueusd END
g2 = CASE WHEN q2.revenueusd = 0 THEN (q2.ppnenet - q3.ppnenet) / 100 ELSE (q2.ppnenet - q3.ppnenet) / q2.revenueusd END
g3 = CASE WHEN q3.revenueusd = 0 THEN (q3.ppnenet - q4.ppnenet) / 100 ELSE (q3.ppnenet - q4.ppnenet) / q3.revenueusd END
incomes = [q.netinc / q.assets FOR q IN [q0, q1, q2, q3, q4, q5, q6, q7] IF q IS NOT NULL AND q.assets IS DISTINCT FROM 0]
risen = [coalesce(d > 0, false) FOR d IN [q0.netinc - q4.netinc, q1.netinc - q5.netinc, q2.netinc - q6.netinc, q3.netinc - q7.netinc]]
gm = (revenueusd - cor) / nullif(revenueusd, 0)
gm_p = (p.revenueusd - p.cor) / nullif(p.revenueusd, 0)
"""

FORMULAS = """
cashpr = (marketcap + debtnc - assets) / nullif(cashneq, 0)
cash = cashnequsd / nullif(assetsavg, 0)
bm = equityusd / nullif(marketcap, 0)
cfp = ncfo / nullif(marketcap, 0)
currat = assetsc / nullif(liabilitiesc, 0)
depr = depamor / nullif(ppnenet, 0)
dep_ppne = depamor / nullif(ppnenet, 0)
ep = netinc / nullif(marketcap, 0)
lev = liabilities / nullif(marketcap, 0)
quick = (assetsc - inventory) / nullif(liabilitiesc, 0)
rd_mve = rnd / nullif(marketcap, 0)
rd_sale = rnd / nullif(revenueusd, 0)
roic = (ebit - revenueusd + cor + opinc) / nullif(equity + liabilities + cashneq - investmentsc, 0)
salecash = revenueusd / nullif(cashneq, 0)
saleinv = revenueusd / nullif(inventory, 0)
salerec = revenueusd / nullif(receivables, 0)
sp = revenueusd / nullif(marketcap, 0)
tb = taxexp / nullif(netinc, 0)
tang = (cashnequsd + receivables * 0.715 + inventory * 0.547 + ppnenet * 0.535) / nullif(assets, 0)
debtc_sale = debtc / nullif(revenueusd, 0)
eqt_marketcap = (equityusd - intangibles) / nullif(marketcap, 0)
tangibles_marketcap = tangibles / nullif(marketcap, 0)
profitmargin = netinc / nullif(revenueusd, 0)
roaq = q0.netinc / nullif(q1.assets, 0)
chtx = (q0.taxexp - q4.taxexp) / nullif(q4.taxexp, 0)
rsup = (q0.revenueusd - q4.revenueusd) / nullif(q0.marketcap, 0)
sue = (q0.netinc - q4.netinc) / nullif(q0.marketcap, 0)
cinvest = g0 - (g1 + g2 + g3) / 3
nincr = CAST(list_position(risen || [false], false) - 1 AS INT)
roavol = CASE WHEN list_count(incomes) = len(incomes) THEN list_aggregate(incomes, 'stddev_pop') END
agr = (assets - p.assets) / nullif(p.assets, 0)
cashdebt = 2 * (revenueusd + depamor) / nullif(liabilities - p.liabilities, 0)
chcsho = (sharesbas - p.sharesbas) / nullif(p.sharesbas, 0)
chinv = (inventory - p.inventory) / nullif(assetsavg, 0)
egr = (equityusd - p.equityusd) / nullif(p.equityusd, 0)
gma = (revenueusd - cor) / nullif(p.assets, 0)
invest = (ppnenet - p.ppnenet + inventory - p.inventory) / nullif(p.assets, 0)
lgr = (liabilities - p.liabilities) / nullif(p.liabilities, 0)
pchlt = (liabilities - p.liabilities) / nullif(p.liabilities, 0)
operprof = (revenueusd - cor - sgna - intexp) / nullif(p.equityusd, 0)
pchcurrat = (assetsc / nullif(liabilitiesc, 0)) / nullif(p.assetsc / nullif(p.liabilitiesc, 0), 0) - 1
pchdepr = (depamor / nullif(ppnenet, 0)) / nullif(p.depamor / nullif(p.ppnenet, 0), 0) - 1
pchgm_pchsale = gm / nullif(gm_p, 0) - revenueusd / nullif(p.revenueusd, 0)
pchquick = ((assetsc - inventory) / nullif(liabilitiesc, 0)) / nullif((p.assetsc - p.inventory) / nullif(p.liabilitiesc, 0), 0) - 1
pchsale_pchinvt = revenueusd / nullif(p.revenueusd, 0) - inventory / nullif(p.inventory, 0)
pchsale_pchrect = revenueusd / nullif(p.revenueusd, 0) - receivables / nullif(p.receivables, 0)
pchsale_pchxsga = revenueusd / nullif(p.revenueusd, 0) - sgna / nullif(p.sgna, 0)
pchsaleinv = (revenueusd / nullif(inventory, 0)) / nullif(p.revenueusd / nullif(p.inventory, 0), 0) - 1
rd = CASE WHEN p IS NULL OR p.rnd = 0 OR assets = 0 OR p.assets = 0 THEN NULL WHEN (rnd / assets) / (p.rnd / p.assets) - 1 > 0.05 THEN 1 ELSE 0 END
roeq = netinc / nullif(p.equityusd, 0)
sgr = revenueusd / nullif(p.revenueusd, 0) - 1
grcapx = capex / nullif(p.capex, 0) - 1
chtl_lagat = (liabilities - p.liabilities) / nullif(p.assets, 0)
chlct_lagat = (liabilitiesc - p.liabilitiesc) / nullif(p.assets, 0)
chint_lagat = (intexp - p.intexp) / nullif(p.assets, 0)
chdebtnc_lagat = (debtnc - p.debtnc) / nullif(p.assets, 0)
chlt_laginvcap = (liabilities - p.liabilities) / nullif(p.invcap, 0)
chltc_laginvcap = (liabilitiesc - p.liabilitiesc) / nullif(p.invcap, 0)
chint_laginvcap = (intexp - p.intexp) / nullif(p.invcap, 0)
chinvt_lagsale = (inventory - p.inventory) / nullif(p.revenueusd, 0)
chinvt_lagcor = (inventory - p.inventory) / nullif(p.cor, 0)
chinvt_lagact = (inventory - p.inventory) / nullif(p.assetsc, 0)
chint_lagsgna = (intexp - p.intexp) / nullif(p.sgna, 0)
chint_laglt = (intexp - p.intexp) / nullif(p.liabilities, 0)
chppne_laglt = (ppnenet - p.ppnenet) / nullif(p.liabilities, 0)
chpay_lagact = (payables - p.payables) / nullif(p.assetsc, 0)
pchppne = ppnenet / nullif(p.ppnenet, 0) - 1
pchint = intexp / nullif(p.intexp, 0) - 1
chdebtnc_ppne = (debtnc - p.debtnc) / nullif(ppnenet, 0)
chdebtc_sale = (debtc - p.debtc) / nullif(revenueusd, 0)
ps = CASE WHEN p IS NOT NULL AND NOT coalesce(assetsavg = 0 OR p.assetsavg = 0 OR liabilitiesc = 0 OR p.liabilitiesc = 0 OR revenueusd = 0 OR p.revenueusd = 0, false) THEN CAST(list_sum([CAST(coalesce(b, false) AS INT) FOR b IN [netinc > 0, netinc / assetsavg > 0, ncfo > 0, ncfo > netinc, debtnc / assetsavg < p.debtnc / p.assetsavg, assetsc / liabilitiesc > p.assetsc / p.liabilitiesc, sharesbas <= p.sharesbas, gm > gm_p, revenueusd / assetsavg > p.revenueusd / p.assetsavg]]) AS INT) END
chprofitmargin = CASE WHEN revenueusd <> 0 THEN netinc - revenueusd - p.netinc / nullif(p.revenueusd, 0) END
change_sales = revenueusd - p.revenueusd
sin = CASE WHEN industry IN ('Gambling', 'Tobacco', 'Beverages - Brewers', 'Beverages - Wineries & Distilleries') THEN 1 ELSE 0 END
company_age = round((datekey - firstpricedate) / 365.0)
ipo = CASE WHEN datekey - firstpricedate <= 365 THEN 1 ELSE 0 END
"""

#: own values whose industry means matter, and what comes of them
INDUSTRY_STEPS = """
v_bm = equityusd / nullif(marketcap, 0)
v_cfp = ncfo / nullif(marketcap, 0)
v_turn = change_sales / nullif(assetsavg, 0)
v_size = marketcap
v_capex = grcapx
v_margin = chprofitmargin
v_roa = netinc / nullif(assetsavg, 0)
v_cash = ncfo / nullif(assetsavg, 0)
v_rnd = rnd / nullif(assetsavg, 0)
v_invested = capex / nullif(assetsavg, 0)
v_overhead = sgna / nullif(assetsavg, 0)
"""
INDUSTRY = """
bm_ia = own.v_bm - m.v_bm
cfp_ia = own.v_cfp - m.v_cfp
chatoia = own.v_turn - m.v_turn
mve_ia = own.v_size - m.v_size
pchcapex_ia = own.v_capex - m.v_capex
chpmia = own.v_margin - m.v_margin
herf = m.herf
ms = CASE WHEN coalesce(assetsavg = 0 OR netinc = 0, false) THEN NULL ELSE CAST(list_sum([CAST(coalesce(b, false) AS INT) FOR b IN [own.v_roa > m.v_roa, own.v_cash > m.v_cash, ncfo > netinc, own.v_rnd > m.v_rnd, own.v_invested > m.v_invested, own.v_overhead > m.v_overhead]]) AS INT) END
"""


def parsed(lines: str) -> dict[str, str]:
    return dict(x.split(" = ", 1) for x in lines.strip().split("\n"))
