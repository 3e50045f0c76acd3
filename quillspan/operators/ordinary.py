"""Words of business text that are no part of a name."""

# Lower case.
ORDINARY = tuple("""
optiv cadence email e-mail tier workflow workflows trigger triggers vendor vendors assessment assessments questionnaire questionnaires template
templates admin administrator approver approvers description descriptions tprm onetrust ironclad privacy shield appendix apendix contract contracts
notify ownership control controls name names approved elevated critical high moderate low group groups committee board risk risks policy policies
chair dashboard lead head officer chief director manager owner owners created completed change changes data cloud database databases legal finance
compliance security background artificial intelligence metadata key type types contains reassessment diligence due nerdwallet securegrc secureid torii
cursor days mobile phone role roles division activity internal confidential default status submitted assessment's response responses action actions
task tasks assignee collaborators operator condition conditions rule rules section sections inventory library engagement engagements setup automation
recycle bin attribute attributes results result question questions procurement revenue marketing staffing international partners services provider
providers service intake approval approvals offboarding onboarding rejecting rejected published draft final review reviewer reviewers inherent
residual target issue issues incident incidents loss event events scenario scenarios indicator indicators register registers framework process
processes standard standards forum forums street st lane ln avenue ave road rd court ct crescent drive boulevard blvd way place terrace parkway holder
directory monthly quarterly annual annually weekly daily biennial lagging leading continuous known generative operations medium minor non-material
consistency requesting contingent withheld securty unlicaty fessible acommon substantiated investigate investigating escalated restated attested
signature emerging velocity treatment acceptance exception exceptions waiver waivers appetite tolerance limit limits the a an this that these those
and or of for to in on at by with from see figure table note step part page
""".split())
